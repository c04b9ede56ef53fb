"""Readers for text tables, edge lists, points, reviews and results, and planners of byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.functions.exprs import label_and_text


def read_sort_table(spark: SparkSession, path: str, n_columns: int, delimiter: str = ",") -> DataFrame:
    """A headerless, unquoted table of strings, columns c0, c1, ..; rows may be of any length."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n_columns)])
    return spark.read.csv(path, schema=schema, header=False, sep=delimiter, quote="", escape="")


def read_edge_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Distinct edges of tab-separated part files; a line that isn't two integers is an error."""
    return spark.read.csv(path, sep="\t", schema="src long, dst long", mode="FAILFAST").distinct()


def read_edge_list(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Edges of a whitespace-separated list, repeats and self-loops kept.

    Lines that are blank, comments (# or %) or don't begin with two integers are skipped; further fields are ignored.
    With `first` and `last` only sources from first to before last are read.
    """
    lines = spark.read.text(path).select(F.trim(F.col("value")).alias("v"))
    lines = lines.where((F.col("v") != "") & ~F.col("v").startswith("#") & ~F.col("v").startswith("%"))
    field = F.split("v", r"\s+")
    edges = lines.select(F.get(field, F.lit(0)).try_cast("long").alias("src"), F.get(field, F.lit(1)).try_cast("long").alias("dst")).where("src is not null and dst is not null")
    if first is not None:
        edges = edges.where(F.col("src") >= first)
    if last is not None:
        edges = edges.where(F.col("src") < last)
    return edges


def read_graph(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Edges of a file by its suffix: .sg is binary, all else an edge list."""
    if path.endswith(".sg"):
        from weft.sources.csr import read_csr

        return read_csr(spark, path, first, last)
    return read_edge_list(spark, path, first, last)


def node_count(edges: DataFrame) -> DataFrame:
    """(n_nodes): the greatest id of either end, plus one; 0 without edges."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).cast("long").alias("n_nodes"))


def grid_edges(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """Edges of a grid: node r * cols + c and its neighbours above, below, left and right."""
    cell = spark.range(rows * cols).select(F.col("id").alias("src"), F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))

    def step(ok: Column, to: int) -> Column:
        return F.when(ok, F.col("src") + to)

    out = F.array(step(F.col("r") > 0, -cols), step(F.col("r") < rows - 1, cols), step(F.col("c") > 0, -1), step(F.col("c") < cols - 1, 1))
    return cell.select("src", F.explode(out).alias("dst")).where("dst is not null")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(features) of comma-separated floats; a field that isn't a number is dropped."""
    return spark.read.text(path).select(F.expr("filter(transform(split(value, ','), x -> try_cast(trim(x) as float)), x -> x is not null)").alias("features"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of labelled lines, bz2 or plain; a line without a label is skipped."""
    lines = spark.read.text(path)
    label, text = label_and_text(F.col("value"))
    return lines.select(label.alias("label"), text.alias("text")).where("label is not null")


def take_mebibytes(texts: DataFrame, order_col: str, text_col: str, mib: float) -> DataFrame:
    """Rows in order until their characters exceed `mib` MiB; the row that crosses the limit still counts.

    Adds `before`, the characters of the rows before. The sum runs over blocks of rows first, so that no task sees all.
    """
    blocks = texts.withColumn("__block", F.floor(F.col(order_col) / F.lit(65_536)))
    sizes = blocks.groupBy("__block").agg(F.sum(F.length(text_col)).alias("__n"))
    upto = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__block", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__block").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.join(starts, "__block").withColumn("before", (F.col("__start") + F.coalesce(F.sum(F.length(text_col)).over(inside), F.lit(0))).cast("long"))
    return out.where(F.col("before") <= F.lit(int(mib * 2**20))).drop("__block", "__start")


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(worker, node, dist) of result files: arrays of workers with lists of [node, distance]; with `lines` one worker in
    each line."""
    schema = "worker_id long, timestamps array<struct<key:string,value:string>>, local_distances array<array<long>>"
    rows = spark.read.schema(schema).json(path, multiLine=not lines)
    return rows.select(F.col("worker_id").alias("worker"), F.explode("local_distances").alias("x")).select("worker", F.col("x")[0].alias("node"), F.col("x")[1].cast("int").alias("dist"))


def sample_rows(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """Every row whose key's hash (the first 32 bits of its MD5) is divisible by `one_in`: the same rows on every run. A
    null key is never in it."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % one_in == 0)


def row_ranges(spark: SparkSession, size: int, workers: int, row_size: int) -> DataFrame:
    """(worker, start, stop) of byte ranges of whole rows, stop exclusive, for a table of rows of one length."""
    chunk = -(-(-(-size // workers)) // row_size) * row_size
    w = spark.range(workers).withColumnRenamed("id", "worker")
    return w.select("worker", F.least(F.col("worker") * chunk, F.lit(size)).cast("long").alias("start"), F.least((F.col("worker") + 1) * chunk, F.lit(size)).cast("long").alias("stop"))


def group_ranges(spark: SparkSession, size: int, workers: int, granularity: int) -> DataFrame:
    """(worker, base, start, stop) of inclusive byte ranges: the workers of each group cover the object without overlap."""
    share = size // granularity
    w = spark.range(workers).withColumnRenamed("id", "worker").withColumn("i", F.col("worker") % granularity)
    return w.select(
        "worker",
        (F.col("worker") - F.col("i")).alias("base"),
        F.when(F.col("i") == 0, 0).otherwise(F.col("i") * share + 1).cast("long").alias("start"),
        F.when(F.col("i") == granularity - 1, size).otherwise((F.col("i") + 1) * share).cast("long").alias("stop"),
    )
