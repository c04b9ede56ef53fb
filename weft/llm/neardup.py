"""MinHash near-duplicate detection with ProbMinHash signatures of weighted word shingles."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import FILTER_KEYS, lists, map_batches, maybe_in, mix, read, shingle_hashes, ship, spare_name, text_bytes, without_keys
from weft.operators.components import connected_components
from weft.session import materialize

BANDS, ROWS = 32, 6
#: Registers of a signature; a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**6)**32 > 0.9999.
REGISTERS = BANDS * ROWS
#: Buckets up to this size give all their pairs; larger ones are compared with three leaders first.
SMALL_BUCKET = 8
#: Members of a block of a large bucket that are compared in one task.
BLOCK = 512
#: Pairs whose signatures agree in a smaller share aren't verified: 4.8 standard deviations below 0.8.
LIKELY = 0.66


def weighted_shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, text): the distinct shingles of each text in order of hash, and how often each occurs."""
    hashes, counts = shingle_hashes(texts, width)
    doc = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return hashes[at], np.diff(np.append(at, len(hashes))), doc[at]


def prob_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n_docs x registers of element hashes; 0 where a text has no elements).

    An element's arrivals are a Poisson process whose rate is its weight: the gaps are exponential variables drawn from
    the element's hash and the arrival's number, and each arrival falls on one register, also drawn from the hash. A
    register keeps its earliest arrival. A text is done once each of its elements' latest arrival lies after all of its
    registers, so that few elements of a long text ever see a second arrival. Two texts agree in a register with the
    probability Jaccard similarity of their weights.
    """
    times = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, np.uint64)
    active = np.arange(len(elements))
    clock = np.zeros(len(elements))
    done, chunk = 0, 1
    with np.errstate(over="ignore"):
        while len(active):
            number = np.arange(done + 1, done + chunk + 1, dtype=np.uint64)
            draw = mix(elements[active][:, None] ^ (number * np.uint64(0xA24BAED4963EE407))[None, :])
            # 40 bits for the gap, the rest for the register
            gap = -np.log(((draw >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40) / weights[active][:, None]
            at = clock[active][:, None] + np.cumsum(gap, axis=1)
            slot = doc[active][:, None] * registers + ((draw & np.uint64(0xFFFFFF)) % np.uint64(registers)).astype(np.int64)
            late = at[:, -1]
            clock[active] = late
            flat_at, flat_slot = at.ravel(), slot.ravel()
            better = flat_at < times[flat_slot]
            flat_at, flat_slot = flat_at[better], flat_slot[better]
            from_row = np.repeat(active, chunk)[better]
            np.minimum.at(times, flat_slot, flat_at)
            won = times[flat_slot] == flat_at
            owner[flat_slot[won]] = elements[from_row[won]]
            open_docs, which = np.unique(doc[active], return_inverse=True)
            latest = times.reshape(n_docs, registers)[open_docs].max(axis=1)
            active = active[late < latest[which]]
            done += chunk
            chunk = min(max(1, 40_000 // max(len(active), 1)), 64) if done >= 2 else 1
    return owner.reshape(n_docs, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    n, registers = signature.shape
    rows = registers // bands
    parts = signature[:, : bands * rows].reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands)).copy()
        for r in range(rows):
            key = mix(key * np.uint64(0xD1342543DE82EF95) + parts[:, :, r])
    return key


def whole_signatures(stored: list[bytes]) -> np.ndarray:
    """(signature of the weights, signature of the set) in a row for each text; one that has no shingle twice stores one
    for both."""
    parts = [np.frombuffer(x, "<u2") for x in stored]
    return np.stack([x if len(x) == 2 * REGISTERS else np.concatenate([x, x]) for x in parts])


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of registers in which whole signatures agree, of weights or of sets, whichever is more."""
    same = a == b
    return np.maximum(same[:, :REGISTERS].mean(axis=1), same[:, REGISTERS:].mean(axis=1))


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(probability Jaccard, set Jaccard) of elements a with weights x and elements b with weights y, both sorted."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0, 0.0
    plain = len(common) / (len(a) + len(b) - len(common))
    x, y = x.astype(float), y.astype(float)
    p, q = x[ia], y[ib]
    only_a, only_b = x.sum() - p.sum(), y.sum() - q.sum()
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    ratio = q / p
    upto = np.searchsorted(ratio, ratio, "right") - 1
    below = only_a + np.cumsum(p)[upto]
    above = only_b + q.sum() - np.cumsum(q)[upto]
    return float((1.0 / (below / p + above / q)).sum()), plain


class ShingleGroup:
    """Weighted shingles of a group of texts, laid out to hold one against many at once."""

    def __init__(self, elements: list[np.ndarray], weights: list[np.ndarray]):
        self.n = np.array([len(x) for x in elements], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        flat, self.place = np.unique(np.concatenate(elements), return_inverse=True)
        self.share = np.concatenate([w / w.sum() for w in weights])
        self.dense = np.zeros(len(flat))

    def may_reach(self, r: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the others may be similar enough to text r: all that are, and few that aren't.

        With shares p and q, a common shingle adds at most min(p, q), and at most max(p, q) over the sum of all
        maxima, to the probability Jaccard similarity.
        """
        if not len(others):
            return np.zeros(0, bool)
        own = slice(self.begin[r], self.begin[r] + self.n[r])
        self.dense[self.place[own]] = self.share[own]
        n = self.n[others]
        starts = np.cumsum(n) - n
        at = np.repeat(self.begin[others] - starts, n) + np.arange(n.sum())
        p, q = self.dense[self.place[at]], self.share[at]
        self.dense[self.place[own]] = 0
        common = np.add.reduceat((p > 0).astype(np.int64), starts)
        least, most = np.minimum(p, q), np.maximum(p, q)
        whole = 2 - np.add.reduceat(least, starts)
        bound = np.add.reduceat(np.where(p > 0, np.minimum(least, most / np.repeat(whole, n)), 0.0), starts)
        return (common / (self.n[r] + n - common) >= threshold - 1e-9) | (bound >= threshold - 1e-9)


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, whole, keys, sig) of the rows that have an id and a word.

    Keys and signatures are those of the weights and those of the set, whose probability Jaccard similarity is the plain
    one. The two are the same where no shingle occurs twice, and stored once there.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = rows.where("id is not null and t is not null")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            elements, weights, doc = weighted_shingles(texts, width)
            signature = prob_minhash(elements, weights.astype(float), doc, len(texts))
            keys = band_keys(signature).view(np.int64)
            short = (signature & np.uint64(0xFFFF)).astype("<u2")
            some = np.bincount(doc, minlength=len(texts)) > 0
            at = np.flatnonzero(some)
            all_keys, sigs = dict(zip(at.tolist(), keys[at])), {i: short[i].tobytes() for i in at.tolist()}
            twice = np.unique(doc[weights > 1])
            if len(twice):
                here = np.isin(doc, twice)
                plain = prob_minhash(elements[here], np.ones(int(here.sum())), np.searchsorted(twice, doc[here]), len(twice))
                for i, k, x in zip(twice.tolist(), band_keys(plain).view(np.int64), (plain & np.uint64(0xFFFF)).astype("<u2")):
                    all_keys[i] = np.unique(np.concatenate([all_keys[i], k]))
                    sigs[i] += x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array([hashlib.md5(b" ".join(texts[i].lower().split())).digest() for i in at], pa.binary()),
                    lists(np.concatenate([np.zeros(0, np.int64), *all_keys.values()]), np.array([len(x) for x in all_keys.values()], np.int64), pa.int64()),
                    pa.array(list(sigs.values()), pa.binary()),
                ],
                names=["id", "whole", "keys", "sig"],
            )

    return map_batches(rows, run, f"id {kind}, whole binary, keys array<bigint>, sig binary")


def _shingle_table(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, el, wt) of the rows whose id is in `ids`, and of few others. Texts are shuffled only where there are too many
    ids for a filter."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).where("t is not null")
    if ids.limit(FILTER_KEYS + 1).count() <= FILTER_KEYS:
        rows = maybe_in(rows, ids, "id", "maybe").where("maybe").select("id", "t")
    else:
        rows = rows.join(ids.hint("shuffle_hash"), "id", "left_semi")

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            elements, weights, doc = weighted_shingles(texts, width)
            n = np.bincount(doc, minlength=len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(elements.view(np.int64), n, pa.int64()), lists(weights.astype(np.int32), n, pa.int32())],
                names=["id", "el", "wt"],
            )

    return map_batches(rows, run, f"id {kind}, el array<bigint>, wt array<int>")


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _verify(pairs: DataFrame, sigs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts are similar enough. A pair's data meet by b first, then by a."""
    kind = pairs.schema["a"].dataType.simpleString()

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                share = agreement(*(whole_signatures(batch.column(i).to_pylist()) for i in (2, 3)))
                yield batch.filter(pa.array(share >= LIKELY)).select(["a", "b"])

    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    near = materialize(map_batches(both, likely, f"a {kind}, b {kind}"))

    def similar(batches):
        for batch in batches:
            (ao, av), (xo, xv), (bo, bv), (yo, yv) = (_rows_of(batch.column(i)) for i in (2, 3, 4, 5))
            keep = []
            for i in range(batch.num_rows):
                a, x = av[ao[i] : ao[i + 1]].view(np.uint64), xv[xo[i] : xo[i + 1]]
                b, y = bv[bo[i] : bo[i + 1]].view(np.uint64), yv[yo[i] : yo[i + 1]]
                keep.append(max(probability_jaccard(a, x, b, y)) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    right = shingles.select(F.col("id").alias("b"), F.col("el").alias("eb"), F.col("wt").alias("wb"))
    left = shingles.select(F.col("id").alias("a"), F.col("el").alias("ea"), F.col("wt").alias("wa"))
    both = near.join(right, "b").join(left, "a").select("a", "b", "ea", "wa", "eb", "wb")
    return map_batches(both, similar, f"a {kind}, b {kind}")


def _block_links(buckets: DataFrame, labels: DataFrame, sigs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Links, in large buckets, that join members which are still in different classes.

    A bucket's members are split into those in the class of its least member and the others; both sides go in blocks,
    and each pair of blocks, except two of the first side, is one group. A bucket with one class gives nothing, and one
    with few others costs little more than its size. Inside a group likely pairs are verified, the likeliest first,
    unless links found before have joined their classes: a group gives at most a link for each of its classes.
    """
    kind = buckets.schema["id"].dataType.simpleString()
    named = buckets.join(labels.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left")
    named = materialize(named.withColumn("label", F.coalesce("label", "id")))
    mixed = named.groupBy("key").agg(F.min(F.struct("id", "label")).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = mixed.where("lo <> hi").select("key", F.col("x.label").alias("main"))
    rows = named.join(mixed, "key").withColumn("other", F.col("label") != F.col("main"))
    sizes = rows.groupBy("key").agg(F.sum(F.col("other").cast("long")).alias("n_other"), F.sum((~F.col("other")).cast("long")).alias("n_main"))
    rows = rows.join(sizes, "key").join(sigs.select("id", "sig"), "id").join(shingles, "id")
    rows = rows.withColumn("b_other", F.ceil(F.col("n_other") / BLOCK).cast("int")).withColumn("b_main", F.ceil(F.col("n_main") / BLOCK).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.when(F.col("other"), F.col("b_other")).otherwise(F.col("b_main"))).cast("int"))
    # others have negative block numbers; a group is (i, j): j one of others, i either
    rows = rows.withColumn("meets", F.expr("""
        case when other then concat(
          transform(sequence(0, b_main - 1), m -> struct(m as i, blk as j)),
          transform(sequence(0, b_other - 1), o -> struct(-1 - least(o, blk) as i, greatest(o, blk) as j)))
        else transform(sequence(0, b_other - 1), o -> struct(blk as i, o as j)) end"""))
    rows = rows.select("key", "id", "label", "other", "sig", "el", "wt", F.explode("meets").alias("m")).select("key", "m.i", "m.j", "id", "label", "other", "sig", "el", "wt")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = whole_signatures(list(pdf["sig"]))
        label, ids = pdf["label"].to_numpy(), pdf["id"].to_numpy()
        side = pdf["other"].to_numpy(bool)
        across = pdf["i"].iloc[0] >= 0
        left = np.flatnonzero(side)
        right = np.flatnonzero(~side) if across else left
        el = [x.view(np.uint64) for x in pdf["el"]]
        wt = pdf["wt"].to_numpy()
        group = ShingleGroup(el, wt)
        up = {x: x for x in label.tolist()}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        for r in left:
            share = agreement(sig[right], sig[r])
            ok = np.flatnonzero((share >= LIKELY) & (label[right] != label[r]))
            if not across:
                ok = ok[ids[right[ok]] > ids[r]]
            ok = right[ok[np.argsort(-share[ok], kind="stable")]]
            for c in ok[group.may_reach(r, ok, threshold)]:
                x, y = root(label[r]), root(label[c])
                if x != y and max(probability_jaccard(el[r], wt[r], el[c], wt[c])) >= threshold:
                    up[max(x, y)] = min(x, y)
                    a.append(ids[r])
                    b.append(ids[c])
        return pd.DataFrame({"a": np.array(a, ids.dtype), "b": np.array(b, ids.dtype)})

    ship()
    return rows.groupBy("key", "i", "j").applyInPandas(compare, f"a {kind}, b {kind}")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, rep, class, kept) for every row: `rep` the least id with the same words, `class` the least id linked to it.

    Two texts are linked if the probability Jaccard similarity of their weighted word shingles (weight: occurrences),
    or the plain Jaccard similarity of the sets, is `threshold` or more, as verified on the shingles themselves; classes
    are what chains of links join. Words are runs between white space, A-Z in lower case; a text of fewer words than a
    shingle is one shingle. Texts that are null or have no words are never linked, and neither are rows without an id
    (class null, kept). Rows with one id count as one. `kept` marks the row whose id is the class.

    Candidates come from the bands of two signatures, of the weights and of the set, so that either similarity is found.
    Copies are folded first. Buckets of bands up to SMALL_BUCKET members give all pairs; larger ones compare each
    member with three leaders, and then only members that are still in different classes, in blocks.
    """
    table = materialize(_signatures(docs, id_col, text_col, width))
    copies = materialize(table.groupBy("whole").agg(F.min("id").alias("rep")))
    first = table.join(copies, (table.whole == copies.whole) & (table.id == copies.rep), "left_semi").dropDuplicates(["id", "whole"])
    first = materialize(first.select("id", "keys", "sig"))
    member = first.select("id", F.explode("keys").alias("key"))
    stats = member.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("l1"), F.max("id").alias("l2"), F.min(F.struct(F.xxhash64("id", F.lit(1)).alias("h"), "id"))["id"].alias("l3")
    )
    full = materialize(member.join(stats.where("n > 1"), "key"))
    small = full.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    all_pairs = small.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    large = full.where(F.col("n") > SMALL_BUCKET)
    star = large.select(F.explode(F.array_distinct(F.array("l1", "l2", "l3"))).alias("l"), "id").where("l <> id")
    star = star.select(F.least("l", "id").alias("a"), F.greatest("l", "id").alias("b"))
    pairs = all_pairs.union(star).distinct()

    involved = full.select("id").distinct()
    shingles = materialize(_shingle_table(docs, involved, id_col, text_col, width).dropDuplicates(["id"]))
    sigs = materialize(first.join(involved, "id", "left_semi").select("id", "sig").dropDuplicates(["id"]))
    edges = materialize(_verify(pairs, sigs, shingles, threshold))
    labels = connected_components(edges)
    more = materialize(_block_links(large.select("key", "id"), labels, sigs, shingles, threshold))
    if more.limit(1).count():
        labels = connected_components(edges.union(more))

    classes = copies.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("whole", "rep", F.coalesce("component", "rep").alias("class"))
    known = table.select("id", "whole").join(classes, "whole").groupBy("id").agg(F.min("rep").alias("rep"), F.min("class").alias("class"))
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    out = ids.join(known, "id", "left")
    # texts without words are alone
    out = out.select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("class", "id").alias("class"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("class"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class; columns stay as they are.

    Of rows that share a kept id and have the same words one stays, as of rows without an id that have the same words;
    the latter go too where a row with an id has their words. Rows without words all stay. Whole texts aren't shuffled
    to drop rows (see without_keys), except those of rows whose id is null or repeated.
    """
    classes = materialize(near_duplicate_classes(docs, id_col, text_col))
    kept = without_keys(docs, classes.where(~F.col("kept")).select(F.col("id").alias(id_col)), id_col)
    again = materialize(classes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id is null or n > 1").select(F.col("id").alias(id_col)))
    if not again.limit(1).count():
        return kept
    names = [F.col(f"`{c}`") for c in docs.columns]
    odd, words = spare_name(docs.columns, "odd"), spare_name(docs.columns, "words")
    rows = kept.join(again.where(F.col(id_col).isNotNull()).withColumn(odd, F.lit(True)), id_col, "left").select(*names, F.coalesce(odd, F.col(f"`{id_col}`").isNull()).alias(odd))
    plain = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.trim(F.regexp_replace(plain, "[\\x09-\\x0D ]+", " "))
    rows = rows.withColumn(words, F.when(F.length(plain) > 0, F.md5(F.encode(plain, "UTF-8"))))
    # rows without an id meet the digests of the others
    some = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(words).isNotNull()).select(words).distinct()
    alone = rows.where(odd).where(F.col(words).isNull())
    named = rows.where(odd).where(F.col(f"`{id_col}`").isNotNull() & F.col(words).isNotNull()).dropDuplicates([id_col, words])
    nameless = rows.where(odd).where(F.col(f"`{id_col}`").isNull() & F.col(words).isNotNull()).dropDuplicates([words]).join(some, words, "left_anti")
    parts = [rows.where(~F.col(odd)), alone, named, nameless]
    return reduce(DataFrame.union, [p.select(*names) for p in parts])


def op8_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the least id with the same words, its class of near-duplicates, and whether it is the one kept."""
    found = near_duplicate_classes(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("rep").alias("copy_of"), F.col("class").alias("class_id"), "kept")
