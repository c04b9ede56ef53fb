"""Timestamp traces: phases, durations, makespan, and frames of statistics and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The phases of an iteration in their order.
PHASES = ["compute", "alltoall", "reduce", "broadcast", "process"]


def parse_trace(traces: DataFrame) -> DataFrame:
    """(worker, key, ts, trial, iter, phase, phase_no) from (worker, timestamps: array of key and value as text).

    Keys are trial_<t>_start, trial_<t>_end, trial_<t>_iter_<i>_<phase> or names of their own (trial and iter null).
    """
    rows = traces.select("worker", F.explode("timestamps").alias("x")).select("worker", F.col("x.key").alias("key"), F.col("x.value").try_cast("long").alias("ts"))
    trial = F.regexp_extract("key", r"trial_(\d+)", 1)
    number = F.regexp_extract("key", r"_iter_(\d+)_", 1)
    phase = F.regexp_extract("key", r"_iter_\d+_(\w+)$", 1)
    place = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    rows = rows.select("worker", "key", "ts", trial.try_cast("int").alias("trial"), number.try_cast("int").alias("iter"), F.nullif(phase, F.lit("")).alias("phase"))
    return rows.withColumn("phase_no", F.when(place > 0, place.cast("int")))


def phase_durations(events: DataFrame) -> DataFrame:
    """(worker, trial, iter, phase, ms): the time since the phase before of the same worker and trial; trials start at
    their start mark."""
    marks = events.where("(iter is not null and phase is not null) or key rlike 'trial_[0-9]+_start$'")
    marks = marks.withColumn("iter", F.coalesce("iter", F.lit(-1)))
    before = Window.partitionBy("worker", "trial").orderBy("iter", F.col("phase_no").asc_nulls_first(), "ts")
    out = marks.withColumn("ms", F.col("ts") - F.lag("ts").over(before))
    return out.where("iter >= 0 and ms is not null").select("worker", "trial", "iter", "phase", "ms")


def mean_phase(durations: DataFrame) -> DataFrame:
    """(compute, comm): mean time of the compute phase, and of the phases that exchange after it; 0 without any."""
    compute = F.avg(F.when(F.col("phase") == "compute", F.col("ms")))
    comm = F.avg(F.when(F.col("phase").isin("alltoall", "broadcast"), F.col("ms")))
    return durations.agg(F.coalesce(compute, F.lit(0.0)).alias("compute"), F.coalesce(comm, F.lit(0.0)).alias("comm"))


def trial_times(events: DataFrame) -> DataFrame:
    """(worker, trial, ms) between a trial's start and end marks."""
    ends = events.where("key rlike '^trial_[0-9]+_(start|end)$'")
    out = ends.groupBy("worker", "trial").agg(
        F.max(F.when(F.col("key").endswith("_start"), F.col("ts"))).alias("a"), F.max(F.when(F.col("key").endswith("_end"), F.col("ts"))).alias("b")
    )
    return out.select("worker", "trial", (F.col("b") - F.col("a")).alias("ms")).where("ms is not null")


def load_times(events: DataFrame) -> DataFrame:
    """(worker, ms) between a worker's start and the mark of its graph."""
    out = events.groupBy("worker").agg(
        F.max(F.when(F.col("key") == "worker_start", F.col("ts"))).alias("a"), F.max(F.when(F.col("key") == "graph_generated", F.col("ts"))).alias("b")
    )
    return out.select("worker", F.coalesce(F.col("b") - F.col("a"), F.lit(0)).alias("ms"))


def distinct_trials(events: DataFrame) -> DataFrame:
    """(trial, n_iterations, first, last): the trials of the traces and their distinct iterations."""
    rows = events.where("trial is not null and iter is not null")
    return rows.groupBy("trial").agg(F.countDistinct("iter").alias("n_iterations"), F.min("iter").alias("first"), F.max("iter").alias("last"))


def makespan(events: DataFrame) -> DataFrame:
    """(ms): the last worker's end less the first one's start."""
    last = F.max(F.when(F.col("key") == "worker_end", F.col("ts")))
    first = F.min(F.when(F.col("key") == "worker_start", F.col("ts")))
    return events.agg((last - first).alias("ms"))


def merge_stats(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def update_stats(stats: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """stats with the columns of `more` by key; keys that `more` lacks keep nulls."""
    return stats.join(more, key, "left")


def flatten_results(results: DataFrame) -> DataFrame:
    """One row for each record of (results: array of records or null); null results give nothing."""
    return results.where(F.col("results").isNotNull()).select(F.explode("results").alias("x")).select("x.*")


def gantt(results: DataFrame) -> DataFrame:
    """(fn, wait_ms, run_ms) in order of submission, from (fn, submit, start, end) in epoch milliseconds."""
    first = results.agg(F.min("submit").alias("t0"))
    return results.crossJoin(F.broadcast(first)).select("fn", (F.col("start") - F.col("t0")).alias("wait_ms"), (F.col("end") - F.col("start")).alias("run_ms")).orderBy("wait_ms", "fn")
