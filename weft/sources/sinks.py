"""Writers: ordered part files, staged buckets, results and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted_csv(df: DataFrame, key: str, path: str, partitions: int, *ties: str) -> None:
    """Unquoted CSV whose part files, taken in order of name, are sorted by key (nulls last) and ties."""
    order = [F.col(key).asc_nulls_last(), *[F.col(t) for t in ties]]
    df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.csv(path, quote="", escape="", emptyValue="")


def stage_buckets(df: DataFrame, bucket_col: str, path: str) -> None:
    """Parquet with a folder for each bucket; empty buckets have none."""
    df.repartition(bucket_col).write.partitionBy(bucket_col).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.write.json(path)


def write_stats(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.csv(path, header=True)
