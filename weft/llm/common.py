"""What the corpus operators share: shipping code to executors, Arrow batches, vectorised hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.session import materialize, ship

#: Rows of an Arrow batch; texts may be long.
BATCH_ROWS = 512


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(fn, schema) with batches of at most BATCH_ROWS rows."""
    ship()
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(id_col: str, parts: int):
    """The rows whose crc32 of the id as text leaves 2 when divided by `parts`."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 2, F.lit(False))


def least_hashes(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The rows of df whose hash of the columns is among the n least (repeated rows share one and stay together).

    Only hashes are ranked, so that no task gathers whole rows of all the others.
    """
    h = F.xxhash64(*columns)
    top = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h").alias("h")).first()["h"]
    return df.where(h <= top) if top is not None else df.limit(0)


#: Bits of a filter of keys: 8 MB in rows of 4 KB, whatever the number of keys.
FILTER_BITS, FILTER_ROW = 1 << 26, 1 << 15
#: Keys that a filter takes; with more of them it would let too much through.
FILTER_KEYS = FILTER_BITS // 4
#: Rows that may be sent to all tasks where they are counted first.
FEW = 1_000_000


def maybe_in(rows: DataFrame, keys: DataFrame, column: str, flag: str) -> DataFrame:
    """rows with a flag: false only if the row's value of `column` is surely not among those of `keys`.

    A hash of each key sets a bit of a bitmap of FILTER_BITS bits, which all tasks get; rows aren't shuffled. `column`
    names the key on both sides. Null is never among the keys.
    """

    def place(name: str):
        return F.pmod(F.xxhash64(F.col(f"`{name}`"), F.lit(17)), F.lit(FILTER_BITS))

    bits = keys.where(F.col(f"`{column}`").isNotNull()).select(place(column).alias("p"))
    bits = bits.groupBy(F.floor(F.col("p") / FILTER_ROW).alias(f"{flag}_row")).agg(F.bitmap_construct_agg(F.col("p") % FILTER_ROW).alias(f"{flag}_bits"))
    there = rows.withColumn(f"{flag}_place", place(column)).withColumn(f"{flag}_row", F.floor(F.col(f"{flag}_place") / FILTER_ROW))
    at = f"({flag}_place % {FILTER_ROW})"
    byte = f"cast(conv(hex(substring({flag}_bits, cast({at} div 8 + 1 as int), 1)), 16, 10) as bigint)"
    test = F.expr(f"coalesce(`{column}` is not null and getbit({byte}, cast({at} % 8 as int)) = 1, false)")
    return there.join(F.broadcast(bits), f"{flag}_row", "left").withColumn(flag, test).drop(f"{flag}_row", f"{flag}_place", f"{flag}_bits")


def without_keys(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose value of `column` isn't among those of `keys` (nulls stay); columns as they are.

    Whole rows are not shuffled as long as a filter takes the keys: of the rows that it lets through, only the values of
    `column` are held against the keys, and the few that it let through wrongly are sent to all tasks. Else both sides
    are shuffled.
    """
    names = [F.col(f"`{c}`") for c in rows.columns]
    key = spare_name(rows.columns, "key")
    gone = materialize(keys.select(F.col(f"`{column}`").alias(key)).where(F.col(key).isNotNull()).distinct())
    n = gone.count()
    if not n:
        return rows
    copied = rows.withColumn(key, F.col(f"`{column}`"))
    if n <= FILTER_KEYS:
        flag = spare_name(rows.columns, "maybe")
        marked = maybe_in(copied, gone, key, flag)
        wrong = materialize(marked.where(flag).select(key).distinct().join(gone, key, "left_anti"))
        if wrong.limit(FEW + 1).count() <= FEW:
            right = spare_name(rows.columns, "right")
            kept = marked.join(F.broadcast(wrong.withColumn(right, F.lit(True))), key, "left").where(f"not {flag} or {right}")
            return kept.select(*names)
    return copied.join(gone, key, "left_anti").select(*names)


def spare_name(taken: list[str], name: str) -> str:
    """A column name like `name` that none of the taken ones clashes with, in any case of letters."""
    low = {c.lower() for c in taken}
    out = f"weft_{name}"
    while any(c.startswith(out) for c in low):
        out += "_"
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE = 0x9E3779B97F4A7C15


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        done, step = 1, np.uint64(base)
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * step
            done += k
            step = np.uint64((int(step) * int(step)) & (2**64 - 1))
    return out


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, hashes, counts): where the words of all texts are in `data`, their 64-bit hashes, and the
    number of words of each text.

    A word is a longest run of bytes that are neither a space nor 0x09 to 0x0D, with A-Z in lower case.
    """
    joined = b" ".join(texts).lower() + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    n = len(data)
    is_space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(is_space[1:] != is_space[:-1]) + 1
    if n and not is_space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    with np.errstate(over="ignore"):
        up = powers(n, _BASE)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * up, dtype=np.uint64)])
        down = powers(n, _inverse(_BASE))
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(starts, bounds)
    return joined, starts, ends, hashes, np.diff(np.concatenate([[0], upto]))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number of words of each text; see word_spans."""
    return word_spans(texts)[3:]


def shingle_hashes(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words of each text in order, and the number of each text's runs.

    A text of fewer words, but one at least, has one run: all its words. A text without words has none.
    """
    words, counts = word_hashes(texts)
    if not len(words):
        return words, np.zeros(len(texts), np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(counts) - counts
    inside = np.arange(len(words)) - begin[doc]
    first = inside <= np.maximum(counts[doc] - width, 0)
    at = np.flatnonzero(first)
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for j in range(width):
            here = at + j
            ok = inside[at] + j < counts[doc[at]]
            out += np.where(ok, words[np.minimum(here, len(words) - 1)] * np.uint64((2 * j + 3) * 0xD6E8FEB86659FD93 & (2**64 - 1)), np.uint64(0))
        out = mix(out)
    return out, np.bincount(doc[at], minlength=len(texts)).astype(np.int64)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the values of all rows and each row's number of them."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
