"""Quality classifier: similarity-weighted nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import held_out, map_batches, mix, read, spare_name, text_bytes, word_hashes

#: Labelled rows that the classifier is fitted on, at most: those with the least hashes of their ids, so that labels keep
#: their shares at any size.
LABELLED = 4000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 25, 8.0
#: Kinds of bytes: 0 space, 1 line end, 2 lower case, 3 upper case, 4 digit, 5 outside ASCII; the rest stand for themselves.
KINDS = 40
PAIRS = KINDS * KINDS
#: Columns that words are hashed to, and how long their part of a vector is beside the run pairs' part.
WORDS, WORD_WEIGHT = 2048, 0.5
#: Labelled rows that are laid out at once.
BLOCK = 512
LEVELS = 24
MEASURES = 6
FEATURES = PAIRS + WORDS + MEASURES * LEVELS


def _kind_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    signs = iter(range(6, KINDS))
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 5
        elif c in "\n\r":
            table[b] = 1
        elif c.isspace() or b < 32 or b == 127:
            table[b] = 0
        elif c.islower():
            table[b] = 2
        elif c.isupper():
            table[b] = 3
        elif c.isdigit():
            table[b] = 4
        else:
            table[b] = next(signs)
    return table


def shape_counts(texts: list[bytes]) -> np.ndarray:
    """texts x FEATURES: how often a run of one kind of bytes follows a run of another, how often words occur (by hash),
    and six measures as soft levels.

    The measures: share of upper case among letters, of signs, of digits among the visible bytes, of words that repeat
    the one before, of trigrams of words seen before in the text, and the mean length of a word.
    """
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(n), lengths + 1)
    table = _kind_table()
    kind = table[data]
    totals = np.bincount(doc * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    totals[:, 1] -= 1
    starts = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])]))
    k, d = kind[starts], doc[starts]
    same = d[1:] == d[:-1]
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :PAIRS] = np.bincount((d[1:] * PAIRS + k[:-1] * KINDS + k[1:])[same], minlength=n * PAIRS).reshape(n, -1)

    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(n), counts)
    out[:, PAIRS : PAIRS + WORDS] = np.bincount(owner * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, -1)
    repeats = np.zeros(n)
    seen = np.zeros(n)
    if len(words) > 2:
        again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner[1:][again], minlength=n)
        inside = owner[2:] == owner[:-2]
        with np.errstate(over="ignore"):
            three = mix(words[2:] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[:-2] * np.uint64(7))[inside]
        who = owner[2:][inside]
        order = np.lexsort((three, who))
        three, who = three[order], who[order]
        old = (three[1:] == three[:-1]) & (who[1:] == who[:-1])
        seen = np.bincount(who[1:][old], minlength=n)
    letters = totals[:, 2] + totals[:, 3] + totals[:, 5]
    visible = np.maximum(totals[:, 2:].sum(axis=1), 1)
    n_words = np.maximum(counts, 1)
    measures = np.stack(
        [
            totals[:, 3] / np.maximum(letters, 1),
            totals[:, 6:].sum(axis=1) / visible,
            totals[:, 4] / visible,
            repeats / n_words,
            seen / n_words,
            np.minimum(visible / n_words / 24, 1),
        ],
        axis=1,
    )
    place = np.sqrt(np.clip(measures, 0, 1)) * (LEVELS - 1)
    soft = np.maximum(0, 1 - np.abs(place[:, :, None] - np.arange(LEVELS)) / 2)
    soft[counts == 0] = 0
    out[:, PAIRS + WORDS :] = soft.reshape(n, -1)
    return out


class Blocks(Sequence):
    """Rows made again each time that they are read, block by block."""

    def __init__(self, make: Callable[[int], np.ndarray], starts: range):
        self.make, self.starts = make, starts

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.make(self.starts[i])


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: dampened shares of the run pairs and of the words, each by inverse document frequency and of
    a length of their own, beside the measures."""
    parts = []
    for at, end, weight in ((0, PAIRS, 1.0), (PAIRS, PAIRS + WORDS, WORD_WEIGHT)):
        some = counts[:, at:end]
        share = some / np.maximum(some.sum(axis=1, keepdims=True), 1)
        x = np.log1p(100 * share) * idf[at:end]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        parts.append(x / np.maximum(norm, 1e-12) * weight)
    x = np.concatenate([*parts, counts[:, PAIRS + WORDS :] * 0.7], axis=1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.maximum(norm, 1e-12)


def latent_axes(blocks: list[np.ndarray], width: int, dimensions: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors (width x dimensions) of the blocks' rows, by subspace iteration: no more than a
    block and a few vectors are held besides the rows."""
    k = min(dimensions + 8, width)
    axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, k)))[0]
    for _ in range(rounds):
        onto = np.zeros((width, k))
        for x in blocks:
            onto += x.T @ (x @ axes)
        axes = np.linalg.qr(onto)[0]
    inner = np.zeros((k, k))
    for x in blocks:
        y = x @ axes
        inner += y.T @ y
    _, turn = np.linalg.eigh(inner)
    return axes @ turn[:, ::-1][:, : min(dimensions, k)]


def fit(counts: Sequence[np.ndarray], labels: np.ndarray, dimensions: int = DIMENSIONS) -> dict:
    """idf, axes (features x dimensions) and the labelled rows' unit vectors, from blocks of the rows' counts."""
    seen = sum((x[:, : PAIRS + WORDS] > 0).sum(axis=0) for x in counts)
    idf = np.log((1 + len(labels)) / (1 + seen)) + 0.2
    blocks = [weigh(x, idf).astype(np.float32) for x in counts]
    axes = latent_axes(blocks, FEATURES, dimensions)
    latent = np.concatenate([x @ axes for x in blocks])
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    return {"idf": idf.astype(np.float32), "axes": axes.astype(np.float32), "vectors": (latent / np.maximum(norm, 1e-12)).astype(np.float32), "labels": labels.astype(np.float32)}


def vote(model: dict, counts: np.ndarray, k: int = NEIGHBOURS, block: int = 1024) -> np.ndarray:
    """The share of label 1 among the k nearest labelled vectors, weighted by exp(SHARPNESS * cosine).

    Products are exact and taken in blocks of labelled vectors. A row without features gets the mean label.
    """
    latent = weigh(counts, model["idf"]) @ model["axes"]
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = latent / np.maximum(norm, 1e-12)
    vectors, labels = model["vectors"], model["labels"]
    k = min(k, len(labels))
    best = np.full((len(latent), 0), 0.0)
    best_label = np.full((len(latent), 0), 0.0)
    for at in range(0, len(vectors), block):
        cosine = latent @ vectors[at : at + block].T
        both = np.concatenate([best, cosine], axis=1)
        marks = np.concatenate([best_label, np.broadcast_to(labels[at : at + block], cosine.shape)], axis=1)
        if both.shape[1] > k:
            pick = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best, best_label = np.take_along_axis(both, pick, 1), np.take_along_axis(marks, pick, 1)
        else:
            best, best_label = both, marks
    weight = np.exp(SHARPNESS * best)
    score = (weight * best_label).sum(axis=1) / weight.sum(axis=1)
    return np.where(norm[:, 0] > 0, np.clip(score, 0, 1), labels.mean())


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> dict | None:
    """The fitted model, from at most `most` labelled rows that aren't held out; None if no row has a label.

    Rows are those with the least hashes of their ids. An id with several labels counts with the least of them, one with
    several texts with the least of these. Labels that are null or neither 0 nor 1 are ignored.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out("id", 4)).groupBy("id").agg(F.min("y").alias("y"))
    # a limit bounds the sample, so it may be broadcast
    sample = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(most))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).join(sample, "id")
    rows = rows.groupBy("id", "y").agg(F.min("t").alias("t"))

    def run(batches):
        for batch in batches:
            counts = shape_counts(text_bytes(batch.column(2)))
            rows_at, cols = np.nonzero(counts)
            n = np.bincount(rows_at, minlength=len(counts))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(cols.astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(counts[rows_at, cols]))],
                names=["id", "y", "at", "value"],
            )

    found = map_batches(rows, run, "id string, y int, at array<smallint>, value array<float>").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by("id").combine_chunks()

    def dense(at: int) -> np.ndarray:
        some = found.slice(at, BLOCK)
        out = np.zeros((some.num_rows, FEATURES), np.float32)
        for i, (columns, values) in enumerate(zip(some["at"], some["value"])):
            out[i, columns.values.to_numpy()] = values.values.to_numpy()
        return out

    return fit(Blocks(dense, range(0, found.num_rows, BLOCK)), found["y"].to_numpy())


def score_quality(docs: DataFrame, model: dict | None, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 from 0.7 on), under the given names.

    The whole text is read. A null or empty text has no features and gets the mean label of the sample, as every text
    does without a model (then 0.5). Columns of docs that already have these names, in any case of letters, are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    taken = {n.lower() for n in names}
    keep = [c for c in docs.columns if c.lower() not in taken]
    place = keep.index(text_col)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            texts = text_bytes(batch.column(place))
            score = vote(fitted, shape_counts(texts)) if fitted else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.7).astype(np.int32))], names=[*batch.schema.names, *names])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep]), run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score_quality predicts as 1, with their columns as they are."""
    names = (spare_name(docs.columns, "score"), spare_name(docs.columns, "predicted"))
    scored = score_quality(docs, fit_quality(docs, labels), names=names)
    return scored.where(F.col(names[1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out, its score and the predicted label; null and empty texts get the mean label."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", "predicted")
