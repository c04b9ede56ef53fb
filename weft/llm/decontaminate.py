"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import map_batches, mix, read
from weft.session import materialize

#: Characters of benchmark text that are broadcast at once; a larger benchmark is taken in blocks of so much.
BLOCK_CHARS = 4_000_000
#: Entries of the index that are laid out at once, and diagonals that are aligned at once.
LAID_OUT, DIAGONALS = 1_000_000, 8192


def _lower_table() -> np.ndarray:
    """Lower case of each character of the basic plane that has a single one; every white space becomes a space."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
        if chr(c).isspace():
            out[c] = 32
    return out


def normalise(codes: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case with runs of white space as one space, and the place of each character kept."""
    low = lower[np.minimum(codes, 0x10FFFF)]
    keep = np.ones(len(low), bool)
    if len(low) > 1:
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    at = np.flatnonzero(keep)
    return low[at], at


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on; empty if there are fewer."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        spans = {1: mix(codes.astype(np.uint64) + np.uint64(1))}
        width = 1
        while width * 2 <= q:
            one = spans[width]
            spans[width * 2] = one[: len(one) - width] * np.uint64(pow(base, width, 1 << 64)) + one[width:]
            width *= 2
        out, at, left = np.zeros(n, np.uint64), 0, q
        for width in sorted(spans, reverse=True):
            if left >= width:
                out = out * np.uint64(pow(base, width, 1 << 64)) + spans[width][at : at + n]
                at, left = at + width, left - width
    return mix(out)


def banded_distance(pattern: np.ndarray, text: np.ndarray, first: int, last: int, budget: int) -> tuple[int, int, int] | None:
    """The fewest edits that turn `pattern` into a part of `text` that begins between `first` and `last`.

    Only cells within `budget` of these diagonals are filled. Gives (edits, start, end), or None beyond the budget.
    """
    m = len(pattern)
    low = first - budget
    width = last - first + 2 * budget + 1
    columns = np.arange(width) + low
    far = budget + 1
    # row i, cell c: the end of the text's part is at low + c + i
    row = np.where((columns >= max(first, 0)) & (columns <= min(last, len(text))), 0, far).astype(np.int32)
    begin = columns.astype(np.int64)
    padded_low = columns[0]
    steps = np.arange(width, dtype=np.int32)
    for i in range(m):
        at = padded_low + i + steps
        inside = (at >= 0) & (at < len(text))
        chars = np.where(inside, text[np.clip(at, 0, max(len(text) - 1, 0))], 0xFFFFFFFF) if len(text) else np.full(width, 0xFFFFFFFF)
        diagonal = np.where(inside, row + (chars != pattern[i]), far)
        skip_pattern = np.append(row[1:] + 1, far)
        skip_ok = np.append((at[:-1] + 1 <= len(text)) & (at[:-1] + 1 >= 0), False)
        skip_pattern = np.where(skip_ok, skip_pattern, far)
        take = skip_pattern < diagonal
        new = np.where(take, skip_pattern, diagonal)
        start = np.where(take, np.append(begin[1:], begin[-1]), begin)
        # characters of the text that are skipped: a running minimum along the row
        slope = new - steps
        best = np.minimum.accumulate(slope)
        where = np.maximum.accumulate(np.where(slope == best, steps, -1))
        row = np.minimum(best + steps, far).astype(np.int32)
        begin = start[where]
        if row.min() >= far:
            return None
    at = padded_low + m + steps
    ends = np.where((at >= 0) & (at <= len(text)), row, far)
    c = int(ends.argmin())
    if ends[c] > budget:
        return None
    return int(ends[c]), int(begin[c]), int(at[c])


class PassageIndex:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float, least: int):
        self.q = q
        self.lower = _lower_table()
        self.ids, self.codes, self.budget, self.bound, self.words = [], [], [], [], []
        grams, owners, places = [], [], []
        for item, text in items:
            codes, _ = normalise(np.frombuffer((text or "").strip().encode("utf-32-le", "replace"), np.uint32), self.lower)
            m = len(codes)
            if m < q:
                continue
            # the largest budget within `rate` for which the lemma still asks for a fair number of q-grams
            budget = min(int(m * rate), max((m + 1 - q) // (2 * q), 0)) if m >= least else 0
            k = len(self.ids)
            self.ids.append(item)
            self.codes.append(codes)
            self.budget.append(budget)
            self.bound.append(m + 1 - q - budget * q)
            self.words.append(m < least)
            g = qgrams(codes, q)
            grams.append(g)
            owners.append(np.full(len(g), k, np.int64))
            places.append(np.arange(len(g), dtype=np.int64))
        self.budget = np.array(self.budget, np.int64)
        self.bound = np.array(self.bound, np.int64)
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if grams else np.zeros(0, np.int64)
        place = np.concatenate(places) if grams else np.zeros(0, np.int64)
        # equal q-grams of an item that lie less than half a band apart are one entry, at the first place of them: a q-gram
        # of a text then meets few entries of an item, however often the item repeats itself
        part = place // (self.budget[owner] + 1) if grams else place
        order = np.lexsort((place, part, owner, g))
        g, owner, place, part = g[order], owner[order], place[order], part[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        self.several = np.diff(np.append(at, len(g))) > 1
        self.grams, self.owner, self.place = g[at], owner[at], place[at]
        self.longest = max(map(len, self.codes), default=0)
        self.bits = max(16, int(len(g)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.grams >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, band's first diagonal) of every band in which as many places of the text as the lemma asks for begin a
        q-gram that the item has there."""
        g = qgrams(codes, self.q)
        if not len(g) or not len(self.grams):
            return
        at = np.flatnonzero(self.seen[(g >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(at):
            return
        hit = g[at]
        left = np.searchsorted(self.grams, hit, "left")
        n = np.searchsorted(self.grams, hit, "right") - left
        at, left, n = at[n > 0], left[n > 0], n[n > 0]
        if not len(at):
            return
        shift, span = self.longest + 3, len(codes) + self.longest + 6
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        upto = np.cumsum(n)
        begin = 0
        while begin < len(at):
            # so many entries are laid out at once
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + LAID_OUT, "right")))
            k = n[begin:end]
            row = np.repeat(left[begin:end], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            owner = self.owner[row]
            # band b holds the diagonals from b * half on, 2 * half of them; each hit is in two bands, and where an entry
            # stands for several places less than half apart, in one more
            band = (np.repeat(at[begin:end], k) - self.place[row]) // (self.budget[owner] + 1)
            base = owner * span + band + shift
            more, times = np.unique(np.concatenate([base, base - 1, base[self.several[row]] - 2]), return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([counts, times]), minlength=len(keys)).astype(np.int64)
            begin = end
        for key in keys[counts >= self.bound[keys // span]]:
            k = int(key) // span
            yield k, (int(key) % span - shift) * (int(self.budget[k]) + 1)

    def leaks(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the item's best aligned place in each run of touching bands; places are kept ones."""
        out: list[tuple[int, int, int, int]] = []
        found: dict[int, list[tuple[int, int]]] = {}
        for k, first in self.regions(codes):
            half = int(self.budget[k]) + 1
            runs = found.setdefault(k, [])
            if runs and first <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], first + 2 * half - 1)
            else:
                runs.append((first, first + 2 * half - 1))
        for k, runs in found.items():
            pattern, budget = self.codes[k], int(self.budget[k])
            m = len(pattern)
            for first, last in runs:
                best = None
                # a run of bands from overlapping copies can be long: so many diagonals are aligned at once
                for a in range(first, last + 1, DIAGONALS):
                    b = min(a + DIAGONALS - 1, last)
                    low = max(a - budget, 0)
                    piece = codes[low : b + m + budget + 1]
                    exact = self._exact(pattern, piece, a - low, b - low, codes[low - 1] if self.words[k] and low else 32, self.words[k])
                    if exact is not None:
                        best = (0, exact + low, exact + low + m)
                        break
                    got = None if self.words[k] else banded_distance(pattern, piece, a - low, b - low, budget)
                    if got and (best is None or got[0] < best[0]):
                        best = (got[0], got[1] + low, got[2] + low)
                if best:
                    out.append((k, best[1], best[2], best[0]))
        return out

    @staticmethod
    def _exact(pattern: np.ndarray, text: np.ndarray, first: int, last: int, before: int, whole_words: bool) -> int | None:
        """Where the pattern stands as it is, beginning between first and last; with whole_words between other characters
        than letters and digits. before: the character before the text."""

        def joins(c: int) -> bool:
            return chr(c).isalnum()

        m = len(pattern)
        for a in np.flatnonzero(text[max(first, 0) : last + 1] == pattern[0]) + max(first, 0):
            if a + m <= len(text) and np.array_equal(text[a : a + m], pattern):
                if not whole_words or not (joins(int(text[a - 1]) if a else int(before)) or (a + m < len(text) and joins(int(text[a + m])))):
                    return int(a)
        return None


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of at most BLOCK_CHARS characters (an item is never split)."""
    block, chars = [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    for i, t in rows.toLocalIterator():
        if block and chars + len(t) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((i, t))
        chars += len(t)
    if block:
        yield block


def _index(shared, q: int, rate: float, least: int) -> PassageIndex:
    """The index of a broadcast block, built once in each worker."""
    state = shared.value
    if "index" not in state:
        state["index"] = PassageIndex(state["items"], q, rate, least)
    return state["index"]


def leaks_of(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", q: int = 12, rate: float = 0.05, least: int = 40,
) -> DataFrame:
    """(id, leaks) per row of docs, leaks an array of (item, start, end, edits).

    An item leaks into a text if some part of the text is within its budget of edits, after lower case and runs of
    white space as one space. The budget is `rate` of the item's characters, but at most what leaves the q-gram lemma
    half of its q-grams. Items of under `least` characters leak where they stand as whole words without an edit; those of
    under q characters, null ones included, can't be told from chance and are not looked for. Starts and ends count code
    points of the text. A null text is empty; every row of docs gives a row, also with null or repeated ids.

    The benchmark is broadcast in blocks of at most BLOCK_CHARS characters, one after the other: each is a pass over the
    texts, whose finds are written before the next block is sent.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = rows.select("id", "t", F.xxhash64(F.coalesce("t", F.lit(""))).alias("h"))
    whole = item_kind in ("bigint", "int")
    kinds = pa.list_(pa.struct([("item", pa.int64() if whole else pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    leaks_sql = f"array<struct<item:{'bigint' if whole else 'string'},start:int,end:int,edits:int>>"

    def finder(shared):
        def run(batches):
            index = _index(shared, q, rate, least)
            for batch in batches:
                found = []
                for text in batch.column(1).to_pylist():
                    codes, at = normalise(np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32), index.lower)
                    found.append([
                        {"item": index.ids[k], "start": int(at[a]) if a < len(at) else len(text), "end": int(at[b - 1]) + 1 if b else 0, "edits": e}
                        for k, a, b, e in index.leaks(codes)
                    ])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kinds)], names=["id", "h", "leaks"])

        return map_batches(rows, run, f"id {kind}, h bigint, leaks {leaks_sql}")

    blocks = _blocks(benchmark, item_col, item_text_col)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return rows.select("id", F.array().cast(leaks_sql).alias("leaks"))
    if second is None:
        return finder(spark.sparkContext.broadcast({"items": first})).select("id", "leaks")
    parts = []
    for block in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast({"items": block})
        parts.append(materialize(finder(shared).where("size(leaks) > 0")))
        shared.destroy()
    some = reduce(DataFrame.union, parts).groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    ids = rows.select(F.col("id").alias("i"), F.col("h").alias("g"))
    joined = ids.join(some, F.col("i").eqNullSafe(F.col("id")) & (F.col("g") == F.col("h")), "left")
    return joined.select(F.col("i").alias("id"), F.coalesce("leaks", F.array().cast(leaks_sql)).alias("leaks"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = 12, rate: float = 0.05, least: int = 40) -> DataFrame:
    """docs without the rows whose text holds a benchmark item (see leaks_of); columns stay as they are."""
    spark = docs.sparkSession
    place = docs.columns.index(text_col)

    def kept(rows, shared):
        def run(batches):
            index = _index(shared, q, rate, least)
            for batch in batches:
                clean = []
                for text in batch.column(place).to_pylist():
                    codes, _ = normalise(np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32), index.lower)
                    clean.append(not index.leaks(codes))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return map_batches(rows, run, docs.schema)

    blocks = _blocks(benchmark, "item_id", "text")
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        return kept(docs, spark.sparkContext.broadcast({"items": first}))
    out = docs
    for block in chain([first, second], blocks):
        shared = spark.sparkContext.broadcast({"items": block})
        out = materialize(kept(out, shared))
        shared.destroy()
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it holds benchmark passages, how many, which items, and where (item:start:end:edits)."""
    found = leaks_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_leaks"),
        F.array_sort(F.array_distinct(F.expr("transform(leaks, x -> x.item)"))).alias("item_ids"),
        F.expr("array_join(transform(array_sort(transform(leaks, x -> struct(x.start as a, x.item as i, x.`end` as b, x.edits as e))), x -> concat_ws(':', x.i, x.a, x.b, x.e)), ',')").alias("spans"),
    )
