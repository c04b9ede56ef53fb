"""Distributed sort: exact, sketched and sampled quantile bounds, range buckets, exchange, local sort, staged variant, validation."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.exprs import range_bucket
from weft.operators.sketch import ROOM, key_sketch
from weft.session import materialize, parallelism, shared_dir
from weft.sources.byteranges import read_fragments
from weft.sources.tables import sample_rows

#: Distinct keys that one window may run over.
WINDOW_KEYS = 1_000_000


def planned_bounds(df: DataFrame, key: Column, parts: int, room: int = ROOM) -> DataFrame:
    """(bounds): parts - 1 keys at about even places, from a sketch of each task's keys; no key moves. A bound is off by the
    sketch's own error at most, about log2(n / room) / room of all n keys."""
    return bounds_frame(df.sparkSession, key_sketch(df, key, room).quantiles(parts))


def bounds_frame(spark: SparkSession, bounds: list[str]) -> DataFrame:
    return spark.createDataFrame([(bounds,)], "bounds array<string>")


def fragment_bounds(spark: SparkSession, path: str, column: int, parts: int, fragments: int = 20, length: int = 1 << 16, seed: int = 0, delimiter: str = ",") -> DataFrame:
    """(bounds) from a column of delimited lines in seeded fragments of the files alone: what is read doesn't grow with them."""
    fields = F.split(F.col("line").cast("string"), re.escape(delimiter), -1)
    return planned_bounds(read_fragments(spark, path, fragments, length, seed), F.get(fields, F.lit(column)), parts)


def quantile_bounds(df: DataFrame, key: Column, parts: int, room: int = ROOM) -> DataFrame:
    """(bounds): the keys at places int(i / parts * n), i = 1 .. parts - 1, of the sorted keys that aren't null.

    A sketch of each task's keys says between which keys each of them lies; a second pass counts what lies outside of these
    few ranges and keeps the keys inside. Where even those are too many for a window, all keys are dealt into ranges.
    """
    spark = df.sparkSession
    sketch = key_sketch(df, key, room)
    places = [int(i / parts * sketch.n) for i in range(1, parts)]
    if not sketch.error or not places:
        return bounds_frame(spark, sketch.quantiles(parts))
    brackets = [sketch.bracket(p) for p in places]
    edges = sorted({k for b in brackets for k in b if k is not None})
    slots: set[int] = set()
    for low, high in brackets:
        slots.update(range(bisect_left(edges, low) if low is not None else 0, (bisect_left(edges, high) if high is not None else len(edges)) + 1))
    rows = df.select(key.cast("string").alias("k")).where("k is not null").withColumn("slot", range_bucket(F.col("k"), F.array(*map(F.lit, edges))))
    kept = F.when(F.col("slot").isin(sorted(slots)), F.col("k"))
    counts = materialize(rows.groupBy("slot", kept.alias("k")).agg(F.count(F.lit(1)).alias("n")))
    # a row for each slot: twice as many as parts at most
    sizes = {r["slot"]: (r["n"], r["keys"]) for r in counts.groupBy("slot").agg(F.sum("n").alias("n"), F.count("k").alias("keys")).collect()}
    ends = dict(zip(sorted(sizes), accumulate(sizes[s][0] for s in sorted(sizes))))
    wanted = []
    for i, at in enumerate(places, 1):
        slot = next(s for s in sorted(sizes) if at < ends[s])
        wanted.append((slot, at - (ends[slot] - sizes[slot][0]), i))
    if max(sizes[s][1] for s, _, _ in wanted) > WINDOW_KEYS:
        return dealt_bounds(df, key, parts)
    inside = Window.partitionBy("slot").orderBy("k")
    # parts - 1 rows
    asked = F.broadcast(spark.createDataFrame(wanted, "slot long, at long, i int"))
    picked = counts.join(F.broadcast(spark.createDataFrame([(s,) for s in {w[0] for w in wanted}], "slot long")), "slot", "left_semi").withColumn("upto", F.sum("n").over(inside)).join(asked, "slot").where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
    return picked.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda x: x["k"]).alias("bounds"))


def dealt_bounds(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """quantile_bounds by a shuffle of all keys.

    Keys are counted first and dealt into ranges of about equal numbers of keys, whatever they begin with. Running counts
    are taken over the ranges, a row each, and inside the few ranges that hold a wanted place.
    """
    counts = df.select(key.alias("k")).where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # written first: what each range holds may not change between counting and picking
    dealt = materialize(counts.repartitionByRange(parallelism(df.sparkSession), "k").withColumn("p", F.spark_partition_id()))
    by_range = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("p").agg(F.sum("n").alias("rn")).withColumn("start", F.coalesce(F.sum("rn").over(by_range), F.lit(0)))
    total = dealt.agg(F.sum("n").alias("total"))
    wanted = total.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.struct(i.alias("i"), F.floor(i / F.lit(parts) * F.col("total")).cast("long").alias("at")))).alias("w")).select("w.i", "w.at") if parts > 1 else None
    if wanted is None:
        return total.select(F.array().cast("array<string>").alias("bounds"))
    # parts - 1 rows
    hit = ranges.join(F.broadcast(wanted), (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("rn")))
    inside = Window.partitionBy("p").orderBy("k")
    some = hit.groupBy("p").agg(F.first("start").alias("start"), F.collect_list(F.struct("at", "i")).alias("places"))
    picked = dealt.join(F.broadcast(some), "p").withColumn("upto", F.col("start") + F.sum("n").over(inside))
    picked = picked.select("k", "n", "upto", F.explode(F.filter("places", lambda x: (x["at"] < F.col("upto")) & (x["at"] >= F.col("upto") - F.col("n")))).alias("x")).select("k", "x.i")
    return picked.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda x: x["k"]).alias("bounds"))


def sampled_bounds(df: DataFrame, key_col: str, parts: int, one_in: int) -> DataFrame:
    """quantile_bounds of one row in `one_in`, picked by the key's hash: cheap, and the same on every run."""
    return quantile_bounds(sample_rows(df, key_col, one_in), F.col(key_col), parts)


def with_bucket(df: DataFrame, key: Column, bounds: DataFrame) -> DataFrame:
    """df with the array of bounds (one row) and each row's bucket."""
    return df.crossJoin(F.broadcast(bounds)).withColumn("bucket", range_bucket(key, F.col("bounds"))).drop("bounds")


def bucket_stats(df: DataFrame, key: Column, parts: int) -> DataFrame:
    """(bucket, n, low, high)."""
    rows = with_bucket(df.select(key.alias("k")), F.col("k"), quantile_bounds(df, key, parts))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))


def global_rank(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """df with `rank`, each row's place (from 1) in the order of the given columns, nulls last. Rows that agree in all of
    these columns follow each other in no set order.

    Rows are dealt by range and ranked inside their partition; the partitions' sizes give what comes before each, so
    that no single task ranks everything.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    path = f"{shared_dir(df.sparkSession)}/weft-sort-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id())
    dealt.write.parquet(path)
    # written first: what each part holds may not change between counting and ranking
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*keys)
    ranked = dealt.withColumn("__row", F.row_number().over(inside)).join(F.broadcast(starts), "__part")
    return ranked.withColumn("rank", (F.col("__start") + F.col("__row")).cast("long")).drop("__part", "__start", "__row")


def sort_exchange(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """df dealt by range of its first key and sorted in each partition: partitions in turn are the sorted table."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def sort_map(df: DataFrame, key: Column, parts: int, path: str, bounds: DataFrame | None = None) -> DataFrame:
    """The first stage on its own: rows with their buckets, staged as Parquet by bucket; gives what was written. Without
    bounds a sketch plans them."""
    rows = with_bucket(df, key, planned_bounds(df, key, parts) if bounds is None else bounds)
    rows.write.partitionBy("bucket").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def sort_reduce(staged: DataFrame, order: list[str]) -> DataFrame:
    """The second stage on its own: each bucket's rows sorted, with their places in the whole order (`rank`)."""
    sizes = staged.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    ranked = staged.withColumn("__row", F.row_number().over(inside)).join(F.broadcast(starts), "bucket")
    return ranked.withColumn("rank", (F.col("__start") + F.col("__row")).cast("long")).drop("__start", "__row")


def staged_sort(df: DataFrame, key: Column, order: list[str], parts: int, bounds: DataFrame | None = None) -> DataFrame:
    """Both stages, with the shared folder between them."""
    return sort_reduce(sort_map(df, key, parts, f"{shared_dir(df.sparkSession)}/weft-sort-{uuid.uuid4().hex}", bounds), order)


def partition_sizes(df: DataFrame, source: Column, key: Column, size: Column, parts: int) -> DataFrame:
    """(source, bucket, n, bytes) of what each input part sends to each bucket."""
    rows = with_bucket(df.select(source.alias("source"), key.alias("k"), size.alias("size")), F.col("k"), quantile_bounds(df, key, parts))
    return rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))


def size_map(sizes: DataFrame) -> DataFrame:
    """(source, sizes): a map from bucket to bytes for each input part."""
    return sizes.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "bytes")))).alias("sizes"))


def validate_sort(ranked: DataFrame, order: list[str]) -> DataFrame:
    """(n, distinct_ranks, inversions): rows whose order columns, nulls last, are below those of the row before are
    inversions.

    Neighbours are compared inside blocks of ranks and across the blocks' edges.
    """
    key = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"z_{c}"), F.col(c).alias(f"k_{c}"))])
    block = ranked.select("rank", key.alias("k"), F.floor(F.col("rank") / 65_536).alias("b"))
    # the last row of a block also begins the next one's comparison
    edge = block.where("rank % 65536 = 65535").select("rank", "k", (F.col("b") + 1).alias("b")).withColumn("copy", F.lit(True))
    both = block.withColumn("copy", F.lit(False)).union(edge)
    before = Window.partitionBy("b").orderBy("rank")
    seen = both.withColumn("last", F.lag("k").over(before)).where("not copy")
    return seen.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("distinct_ranks"), F.sum(F.when(F.col("k") < F.col("last"), 1).otherwise(0)).cast("long").alias("inversions"))


def uniform_lengths(rows: DataFrame, text: Column) -> DataFrame:
    """(uniform): whether all rows have one length."""
    return rows.agg((F.countDistinct(F.length(text)) == 1).alias("uniform"))
