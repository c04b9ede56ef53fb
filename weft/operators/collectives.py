"""Group data movement as DataFrame exchanges, with what each pair of members moves.

Rows are messages: a sender, a receiver and a body. What a collective moves is counted as rows and bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_to_all(rows: DataFrame, receiver: Column, members: int) -> DataFrame:
    """Every row goes to its receiver's partition: partition j holds what member j gets."""
    return rows.withColumn("receiver", receiver.cast("long")).repartitionById(members, F.col("receiver").cast("int"))


def broadcast(rows: DataFrame, members: int, root: int = 0) -> DataFrame:
    """Every member gets all rows of the root."""
    own = rows.where(F.col("sender") == root)
    return own.withColumn("receiver", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(members - 1).cast("long"))))


def gather(rows: DataFrame, root: int = 0) -> DataFrame:
    """The root gets all rows; they keep their senders, in whose order they are read."""
    return rows.withColumn("receiver", F.lit(root).cast("long"))


def scatter(rows: DataFrame, place: Column, members: int, root: int = 0) -> DataFrame:
    """The root's rows are dealt to the members by place."""
    return rows.where(F.col("sender") == root).withColumn("receiver", F.pmod(place, F.lit(members)).cast("long"))


def pair(rows: DataFrame, members: int) -> DataFrame:
    """Members of the upper half send to those of the lower half; there must be as many of one as of the other."""
    if members % 2:
        raise ValueError("pairs need an even number of members")
    half = members // 2
    return rows.where(F.col("sender") >= half).withColumn("receiver", (F.col("sender") - half).cast("long"))


def halves(rows: DataFrame, n_nodes: int, node: str = "node") -> DataFrame:
    """Two parties keep the nodes of their half and send the other's over."""
    own = F.when(F.col(node) < n_nodes // 2, 0).otherwise(1).cast("int")
    return rows.withColumn("receiver", own.cast("long")).repartitionById(2, own)


def reduce_rows(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): values of equal keys added up, in each task first."""
    return rows.groupBy(key).agg(F.sum(value).alias(value))


def union_ids(rows: DataFrame, node: str, work: str) -> tuple[DataFrame, DataFrame]:
    """(distinct nodes; (has_work): whether any member has work left)."""
    return rows.select(node).distinct(), rows.agg(F.coalesce(F.max(F.col(work).cast("boolean")), F.lit(False)).alias("has_work"))


def concat_ordered(rows: DataFrame, key: str, place: str, body: str) -> DataFrame:
    """(key, body): chunks put together in order of their places. For messages whose chunks fit in a task together."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(place, body))), lambda x: x[body])
    return rows.groupBy(key).agg(F.array_join(ordered, "").alias(body))


#: Collectives by name, as functions of messages, place of the receiver, and number of members.
COLLECTIVES = {
    "all_to_all": all_to_all,
    "broadcast": lambda rows, place, members: broadcast(rows, members),
    "gather": lambda rows, place, members: gather(rows),
    "scatter": lambda rows, place, members: scatter(rows, place, members),
    "pair": lambda rows, place, members: pair(rows, members),
}


def records(rows: DataFrame, place: Column, size: Column, members: int, names: list[str] | None = None) -> DataFrame:
    """(benchmark, senders, receivers, n, payload_size): what each of the named collectives (all without names) moves."""
    out = None
    for name in names or COLLECTIVES:
        moved = COLLECTIVES[name](rows, place, members)
        one = moved.agg(F.countDistinct("sender").alias("senders"), F.countDistinct("receiver").alias("receivers"), F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("payload_size"))
        one = one.select(F.lit(name).alias("benchmark"), "*")
        out = one if out is None else out.union(one)
    return out


def traffic(moved: DataFrame, size: Column) -> DataFrame:
    """(sender, receiver, n, bytes) of what is moved."""
    return moved.groupBy("sender", "receiver").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))


def throughput(moved: DataFrame, size: Column, start: Column, end: Column) -> DataFrame:
    """(worker, mib, seconds, mib_per_s) by sender, times in epoch milliseconds."""
    seconds = (F.max(end) - F.min(start)) / 1000.0
    out = moved.groupBy(F.col("sender").alias("worker")).agg((F.sum(size) / 1048576.0).alias("mib"), seconds.alias("seconds"))
    return out.withColumn("mib_per_s", F.when(F.col("seconds") > 0, F.col("mib") / F.col("seconds")))


def total_throughput(by_worker: DataFrame) -> DataFrame:
    """(workers, mib_per_s): throughputs of all workers added up."""
    return by_worker.agg(F.count(F.lit(1)).alias("workers"), F.sum("mib_per_s").alias("mib_per_s"))
