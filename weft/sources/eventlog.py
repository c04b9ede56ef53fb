"""A run's own event log as a trace: what Spark writes of each task, read as marks of workers, trials and phases."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import shared_dir

#: The part of a task's entry in the event log that is read.
TASK = """
    Event string, `Stage ID` long, `Stage Attempt ID` int, `Task Type` string, `Task End Reason` struct<Reason: string>,
    `Task Info` struct<`Task ID`: long, `Index`: long, `Attempt`: int, `Launch Time`: long, `Executor ID`: string, `Finish Time`: long>,
    `Task Metrics` struct<
        `Executor Run Time`: long,
        `Shuffle Read Metrics`: struct<`Fetch Wait Time`: long, `Remote Bytes Read`: long, `Local Bytes Read`: long, `Total Records Read`: long>,
        `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long, `Shuffle Write Time`: long>,
        `Input Metrics`: struct<`Bytes Read`: long, `Records Read`: long>>
"""


@contextmanager
def recorded(spark: SparkSession) -> Iterator[str]:
    """Here everything that the session runs is logged to a file in the shared folder, whose path this gives. The file is
    whole once the block has been left. Applications that log from their start on (spark.eventLog.enabled) need none of this.
    """
    context = spark.sparkContext
    jvm, core = context._jvm, context._jsc.sc()
    folder = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(folder)
    hadoop = context._jsc.hadoopConfiguration()
    path.getFileSystem(hadoop).mkdirs(path)
    # one plain file, which any reader can split
    conf = core.conf().clone().set("spark.eventLog.compress", "false").set("spark.eventLog.rolling.enabled", "false").set("spark.eventLog.logStageExecutorMetrics", "false")
    name = "weft"
    log = jvm.org.apache.spark.scheduler.EventLoggingListener(name, jvm.scala.Option.empty(), path.toUri(), conf, hadoop)
    log.start()
    core.addSparkListener(log)
    try:
        yield f"{folder}/{name}"
    finally:
        # the end of the last task may still be on its way
        core.listenerBus().waitUntilEmpty()
        core.removeSparkListener(log)
        log.stop()


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each end of a task in an event log (a file, or the folder of a rolling log): stage, attempt of the stage,
    part, attempt of the task, executor, launch and finish in epoch milliseconds, whether it succeeded, milliseconds of
    running, waiting for a shuffle and writing one, records and bytes read from tables, and bytes moved by shuffles.

    Lines that are no entries (a log that is still being written may end in one) give nothing. A task that failed before it
    ran has no figures: its times and sizes are 0.
    """
    entries = spark.read.schema(TASK).json(path).where("Event = 'SparkListenerTaskEnd'")
    info, metrics = F.col("`Task Info`"), F.col("`Task Metrics`")
    read, write, table = metrics["Shuffle Read Metrics"], metrics["Shuffle Write Metrics"], metrics["Input Metrics"]

    def figure(column):
        return F.coalesce(column, F.lit(0).cast("long"))

    return entries.select(
        F.col("Stage ID").alias("stage"), F.col("Stage Attempt ID").alias("stage_attempt"), info["Index"].alias("part"), info["Attempt"].alias("attempt"),
        info["Executor ID"].alias("executor"), info["Launch Time"].alias("launch"), info["Finish Time"].alias("finish"),
        (F.col("`Task End Reason`.Reason") == "Success").alias("succeeded"),
        figure(metrics["Executor Run Time"]).alias("run_ms"), figure(read["Fetch Wait Time"]).alias("wait_ms"),
        F.floor(figure(write["Shuffle Write Time"]) / 1e6).cast("long").alias("write_ms"),
        figure(table["Records Read"]).alias("records_read"), figure(table["Bytes Read"]).alias("bytes_read"),
        (figure(read["Remote Bytes Read"]) + figure(read["Local Bytes Read"])).alias("shuffle_read"), figure(write["Shuffle Bytes Written"]).alias("shuffle_written"),
    )


def task_trace(tasks: DataFrame) -> DataFrame:
    """(worker, timestamps) for `trace.parse_trace`, from rows of `read_tasks`; only tasks that succeeded make marks.

    A worker is a partition's number, a trial a stage, an iteration the stage's attempt. A task begins its trial with its
    launch; "compute" is what it ran less what it waited for and wrote, "alltoall" that wait and writing, and "process" the
    rest to its finish (sending, unpacking, the result). worker_start and worker_end are a partition's first launch and last
    finish over all stages.
    """
    done = tasks.where("succeeded and launch is not null and finish >= launch")
    moved = F.least(F.col("wait_ms") + F.col("write_ms"), F.col("run_ms"))
    # clocks of metrics and of marks differ by rounding: no mark lies behind the finish
    computed = F.least(F.col("launch") + F.col("run_ms") - moved, F.col("finish"))
    exchanged = F.least(F.col("launch") + F.col("run_ms"), F.col("finish"))
    trial = F.concat(F.lit("trial_"), F.col("stage"))
    step = F.concat(trial, F.lit("_iter_"), F.col("stage_attempt"), F.lit("_"))
    marks = [
        (F.concat(trial, F.lit("_start")), F.col("launch")),
        (F.concat(step, F.lit("compute")), computed),
        (F.concat(step, F.lit("alltoall")), exchanged),
        (F.concat(step, F.lit("process")), F.col("finish")),
        (F.concat(trial, F.lit("_end")), F.col("finish")),
    ]

    def stamps(pairs):
        return F.array(*[F.struct(key.alias("key"), at.cast("string").alias("value")) for key, at in pairs]).alias("timestamps")

    whole = done.groupBy("part").agg(F.min("launch").alias("a"), F.max("finish").alias("b"))
    ends = whole.select(F.col("part").alias("worker"), stamps([(F.lit("worker_start"), F.col("a")), (F.lit("worker_end"), F.col("b"))]))
    return done.select(F.col("part").alias("worker"), stamps(marks)).union(ends)


def stage_summary(tasks: DataFrame) -> DataFrame:
    """Per stage: tasks that succeeded and failed, milliseconds from first launch to last finish, the longest task's share
    of the mean one (1 without skew), records and bytes read, bytes moved."""
    ok = F.col("succeeded")
    ms = F.when(ok, F.col("finish") - F.col("launch"))
    return tasks.groupBy("stage").agg(
        F.count_if(ok).alias("n_tasks"), F.count_if(~ok).alias("n_failed"), (F.max("finish") - F.min("launch")).alias("ms"),
        F.coalesce(F.try_divide(F.max(ms), F.avg(ms)), F.lit(1.0)).alias("skew"),
        *[F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(c) for c in ("records_read", "bytes_read", "shuffle_read", "shuffle_written")],
    )
