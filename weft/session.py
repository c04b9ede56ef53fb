"""Session settings and tables kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, AQE, Arrow batches small enough for long texts."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset a temporary one is made in local mode alone: on a
    cluster executors wouldn't see it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage, survives the loss of executors, and keeps expensive steps from running once per consumer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, into: str | None = None, partition_by: str | None = None, dealt: bool = False) -> tuple[DataFrame, str]:
    """(table, name): df as a table in the shared folder, bucketed by `key` into as many buckets as there are shuffle
    partitions. Joins and groupings by the key then leave its rows where they are. With `into` the rows are added to that
    table. The table reads as it is now: what is added later isn't in it. dealt: df already lies in partitions by the key.
    """
    spark = df.sparkSession
    name = into or f"weft_{uuid.uuid4().hex}"
    n = parallelism(spark)
    writer = (df if dealt else df.repartition(n, key)).write.mode("append").format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, key)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(name)
    return spark.table(name), name


@contextmanager
def joined_by_part_of_keys(spark: SparkSession) -> Iterator[None]:
    """Here joins take rows that lie together by some of their keys as they lie, as groupings do anyway."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it comes in fewer partitions than there are cores, as small files do; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship() -> None:
    """Lets functions of this package travel by value, so that executors needn't have the package installed."""
    for name, module in list(sys.modules.items()):
        if name == "weft" or name.startswith("weft."):
            cloudpickle.register_pickle_by_value(module)
