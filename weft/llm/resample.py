"""Importance resampling towards a target distribution: word runs hashed into buckets, gains by log ratio, Gumbel draws."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.common import map_batches, read, spare_name, text_bytes
from weft.operators.sort import global_rank
from weft.session import materialize, parallelism

#: Buckets of features, words of the longest run, words that a document needs to be drawn, percentage drawn.
BUCKETS, RUN, LEAST_WORDS, PERCENT = 10_000, 1, 20, 10
#: A trie of more nodes gives its counts away and is begun anew: it never outgrows a task.
TRIE_NODES = 1_000_000

#: Bytes of words as they count: letters A-Z in lower case, all other ASCII but digits and letters as white space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Longest runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


class Node:
    """A run of words: the CRC-32 of its bytes so far, how often it occurs, and the sum of the gains on its path."""

    __slots__ = ("count", "crc", "kids", "path_gain")

    def __init__(self, crc: int, path_gain: int):
        self.count, self.crc, self.kids, self.path_gain = 0, crc, {}, path_gain


class WordTrie:
    """Runs of up to `width` words as paths. A child's CRC goes on from its parent's, so that no run is ever put together;
    with gains each node also carries the gains of the runs on its path."""

    def __init__(self, width: int, buckets: int, gains: list[int] | None = None):
        self.width, self.buckets, self.gains = width, buckets, gains
        self.root, self.nodes = Node(0, 0), 0

    def child(self, node: Node, word: bytes) -> Node:
        found = node.kids.get(word)
        if found is None:
            crc = zlib.crc32(word if node is self.root else b" " + word, node.crc)
            found = node.kids[word] = Node(crc, node.path_gain + self.gains[crc % self.buckets] if self.gains else 0)
            self.nodes += 1
        return found

    def paths(self, words: list[bytes]) -> Iterator[tuple[bytes, ...]]:
        """For each place in turn the longest run that begins there, of `width` words or up to the end."""
        if self.width == 1:
            return zip(words)
        return (tuple(words[i : i + self.width]) for i in range(len(words)))

    def add(self, paths: Counter) -> None:
        """Counts every run that begins one of the given paths, as often as the path occurs."""
        for path, times in paths.items():
            node = self.root
            for word in path:
                node = self.child(node, word)
                node.count += times

    def totals(self) -> np.ndarray:
        """Occurrences of runs in each bucket."""
        out = np.zeros(self.buckets, np.int64)
        held = [self.root]
        while held:
            node = held.pop()
            out[node.crc % self.buckets] += node.count
            held.extend(node.kids.values())
        return out

    def gain(self, words: list[bytes]) -> int:
        """Sum of the gains of all runs: what the ends of the walked paths carry."""
        root, total = self.root, 0
        if self.width == 1:
            kids, child = root.kids, self.child
            for word in words:
                node = kids.get(word)
                total += (node if node is not None else child(root, word)).path_gain
            return total
        for path in self.paths(words):
            node = root
            for word in path:
                node = self.child(node, word)
            total += node.path_gain
        return total


def n_runs(n: int, width: int) -> int:
    """Runs of 1 to `width` consecutive words among n words."""
    return sum(max(n - k, 0) for k in range(width))


def bucket_totals(texts: DataFrame, text_col: str, buckets: int = BUCKETS, width: int = RUN) -> DataFrame:
    """(bucket, n): how many runs of words of all texts fall in each bucket that has any.

    Each task keeps a trie of its own texts and gives one row for each bucket; null texts have no words.
    """

    def run(batches):
        trie, total = WordTrie(width, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                trie.add(Counter(trie.paths(words_of(text))))
                if trie.nodes > TRIE_NODES:
                    total += trie.totals()
                    trie = WordTrie(width, buckets)
        total += trie.totals()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    parts = map_batches(texts.select(F.col(f"`{text_col}`").cast("string")), run, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket, target over source."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def importance_weights(docs: DataFrame, gains: list[int], text_col: str = "text", width: int = RUN) -> DataFrame:
    """docs without the text, with n_features, n_words and weight, the floored mean gain of the document's runs of words
    (none: 0). Columns of docs that already have these names, in any case of letters, are replaced."""
    results = {"n_features", "n_words", "weight"}
    keep = [c for c in docs.columns if c.lower() not in results and c != text_col]
    # a number for each bucket
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    text = spare_name(docs.columns, "text")

    def run(batches):
        table = shared.value
        trie = WordTrie(width, len(table), table)
        for batch in batches:
            n_words, features, weight = [], [], []
            for raw in text_bytes(batch.column(batch.num_columns - 1)):
                words = words_of(raw)
                n = n_runs(len(words), width)
                n_words.append(len(words))
                features.append(n)
                weight.append(trie.gain(words) // n if n else 0)
                if trie.nodes > TRIE_NODES:
                    trie = WordTrie(width, len(table), table)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x, pa.int64()) for x in (features, n_words, weight)]], names=[*keep, "n_features", "n_words", "weight"])

    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, T.LongType()) for n in ("n_features", "n_words", "weight")]])
    return map_batches(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text)), run, schema)


def draw(weighted: DataFrame, id_col: str, seed: int = 2024, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """weighted with score and rank: the given percentage (floored) of the documents with enough words, those of the
    highest scores, ties to the smaller id, is ranked from 1; the others have a null rank.

    A score is the weight plus Gumbel noise from a digest of seed and id, in whole thousandths, so that the draw follows
    the weights without replacement. A null id's digest is that of the seed alone; it comes last among ties. Ranks are
    taken by range partitions, of narrow rows.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weighted.withColumn("score", F.col("weight") + noise))
    able = scored.where(F.col("n_words") >= least_words)
    wanted = able.count() * percent // 100
    ranked = global_rank(able.withColumn("falling", -F.col("score")), ["falling", id_col, "n_features"], parallelism(weighted.sparkSession))
    ranked = ranked.drop("falling").withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", width: int = RUN, buckets: int = BUCKETS, seed: int = 2024, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_features, n_words, weight, score, rank) of every document, drawn towards the texts of `targets`.

    Null and empty texts have no features and weight 0; repeated rows are weighed and ranked one by one; without documents
    there are no rows, without targets all shares of the target are equal.
    """
    source, target = ({r["bucket"]: r["n"] for r in bucket_totals(d, c, buckets, width).collect()} for d, c in ((docs, text_col), (targets, target_col)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = draw(importance_weights(rows, bucket_gains(source, target, buckets), "text", width), "id", seed, least_words, percent)
    return found.withColumnRenamed("id", id_col)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of words, weight towards the benchmark texts, score with noise, rank if drawn."""
    found = resample(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
