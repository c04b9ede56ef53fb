"""Binary graphs in compressed sparse rows: a data source with a partition for each range of nodes, and a writer.

Layout, little endian: a byte for directed, 64-bit numbers of edges and nodes, 64-bit offsets of nodes + 1, and a 32-bit
destination for each edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.session import materialize, parallelism, ship

HEADER = 17
#: Offsets in a block of bytes that a task writes: 512 KB.
BLOCK = 1 << 16


def _file_system(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def _open(path: str):
    fs, inner = _file_system(path)
    return fs.open_input_file(inner)


class NodeRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class CsrReader(DataSourceReader):
    """Reads the offsets of its nodes and their destinations, and nothing else of the file."""

    def __init__(self, options):
        self.path = options["path"]
        self.parts = int(options.get("partitions", "8"))
        self.bounds = (options.get("first"), options.get("last"))

    def _size(self) -> tuple[int, int]:
        with _open(self.path) as f:
            head = f.read(HEADER)
        if len(head) < HEADER:
            raise ValueError(f"{self.path} is no graph file")
        return tuple(int(x) for x in np.frombuffer(head[1:], "<u8"))

    def partitions(self) -> list[NodeRange]:
        _, nodes = self._size()
        first = int(self.bounds[0]) if self.bounds[0] else 0
        last = min(nodes, int(self.bounds[1])) if self.bounds[1] else nodes
        step = max(1, -(-max(last - first, 0) // self.parts))
        return [NodeRange(a, min(a + step, last)) for a in range(first, last, step)] or [NodeRange(0, 0)]

    def read(self, partition: NodeRange) -> Iterator[pa.RecordBatch]:
        a, b = partition.first, partition.last
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
        if b <= a:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], schema=schema)
            return
        _, nodes = self._size()
        with _open(self.path) as f:
            f.seek(HEADER + 8 * a)
            offsets = np.frombuffer(f.read(8 * (b - a + 1)), "<u8").astype(np.int64)
            f.seek(HEADER + 8 * (nodes + 1) + 4 * int(offsets[0]))
            at, end = int(offsets[0]), int(offsets[-1])
            while at < end:
                n = min(1 << 16, end - at)
                dst = np.frombuffer(f.read(4 * n), "<i4").astype(np.int64)
                # an edge's source is the last node that begins at or before it
                source = a + np.searchsorted(offsets, np.arange(at, at + n), "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(source), pa.array(dst)], schema=schema)
                at += n


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_csr"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options)


def read_csr(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, partitions: int = 8) -> DataFrame:
    """Edges (src, dst) in file order of each node; with first and last only of those nodes."""
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CsrSource)
    reader = spark.read.format("weft_csr").option("partitions", str(partitions))
    if first is not None:
        reader = reader.option("first", str(first))
    if last is not None:
        reader = reader.option("last", str(last))
    return reader.load(path)


def write_csr(path: str, edges: list[tuple[int, int]], directed: bool = True) -> None:
    """A small graph file, for tests and exchange; edges of a node keep their order."""
    n = max((max(e) for e in edges), default=-1) + 1
    src = np.array([e[0] for e in edges], np.int64)
    order = np.argsort(src, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]) if n else np.zeros(1)
    with open(path, "wb") as f:
        f.write(bytes([directed]))
        f.write(np.array([len(edges), n], "<u8").tobytes())
        f.write(offsets.astype("<u8").tobytes())
        f.write(np.array([edges[i][1] for i in order], "<i4").tobytes())


def write_csr_frame(edges: DataFrame, path: str, directed: bool = True, partitions: int | None = None) -> None:
    """A graph file from (src, dst), nodes in order and a node's targets in order. Rows with a null end are left out.

    Tasks sort runs of node ids and write each run's offsets and destinations as binary rows, in the file's own bytes. The
    format is one file, so the driver then appends these bytes in order: no row passes it, and it holds one block at a time.
    Runs are even in edges by a sketch of the sources; a hub's edges can't be parted, as its targets lie in order.
    """
    spark = edges.sparkSession
    ship()
    links = materialize(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null"))
    parts = partitions or parallelism(spark)
    size = links.agg(
        F.count(F.lit(1)).alias("m"), F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("n"),
        F.percentile_approx("src", [i / parts for i in range(1, parts)], 100 * parts).alias("b") if parts > 1 else F.lit(None).alias("b"),
    ).first()
    if size["n"] > 1 << 31:
        raise ValueError("destinations of a graph file have 32 bits")
    firsts = [0, *sorted({b for b in size["b"] or () if b > 0})]
    lasts = [*firsts[1:], size["n"]]
    run = F.array_size(F.filter(F.array(*[F.lit(b).cast("long") for b in firsts]), lambda b: b <= F.col("src"))) - 1
    # an edge's place before it is sorted, so that a task meets whole runs
    ordered = links.select(run.alias("run"), "src", "dst").repartition(len(firsts), "run").sortWithinPartitions("run", "src", "dst")
    written = materialize(ordered.mapInArrow(lambda batches: _blocks(batches, firsts, lasts), BLOCKS))
    # where each run's offsets begin: at most a number for each partition
    edges_of = {r["run"]: r["n"] for r in written.groupBy("run").agg(F.sum("n_edges").alias("n")).collect()}
    fs, inner = _file_system(path)
    with fs.open_output_stream(inner) as f:
        f.write(bytes([directed]))
        f.write(np.array([size["m"], size["n"], 0], "<u8").tobytes())
        # runs without edges have no block: their nodes begin where the next run's do
        begin, run = 0, 0
        for r in chain(_in_order(written, True), [None]):
            upto = len(firsts) if r is None else r["run"]
            while run < upto:
                if run not in edges_of:
                    f.write(np.full(lasts[run] - firsts[run], begin, "<u8").tobytes())
                begin += edges_of.get(run, 0)
                run += 1
            if r is not None:
                f.write((np.frombuffer(r["bytes"], "<u8") + np.uint64(begin)).tobytes())
        for r in _in_order(written, False):
            f.write(bytes(r["bytes"]))


def _in_order(written: DataFrame, offsets: bool) -> Iterator:
    rows = written.where(F.col("offsets") == offsets).select("run", "block", "bytes")
    return rows.orderBy("run", "block").toLocalIterator()


BLOCKS = "run int, offsets boolean, block long, n_edges long, bytes binary"


def _blocks(batches: Iterator[pa.RecordBatch], firsts: list[int], lasts: list[int]) -> Iterator[pa.RecordBatch]:
    """Blocks of the file from edges in order of (run, src, dst): a run's destinations, and the ends of its nodes' edges
    counted from the run's beginning. BLOCK numbers at a time, so a node of many edges is never held whole."""
    schema = pa.schema([("run", pa.int32()), ("offsets", pa.bool_()), ("block", pa.int64()), ("n_edges", pa.int64()), ("bytes", pa.binary())])
    numbers = {True: 0, False: 0}

    def block(run: int, offsets: bool, n: int, data: np.ndarray) -> pa.RecordBatch:
        numbers[offsets] += 1
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((run, offsets, numbers[offsets], n, data.tobytes()), schema.types)], schema=schema)

    def ends(run: int, upto: int, node: int, last: int) -> Iterator[pa.RecordBatch]:
        """The same end for all nodes from `node` to before `last`."""
        for a in range(node, last, BLOCK):
            yield block(run, True, 0, np.full(min(BLOCK, last - a), upto, "<u8"))

    now, node, upto = -1, 0, 0
    for batch in batches:
        runs, src, dst = (batch.column(i).to_numpy() for i in range(3))
        for run in np.unique(runs).tolist():
            if run != now:
                if now >= 0:
                    yield from ends(now, upto, node, lasts[now])
                now, node, upto = run, firsts[run], 0
            mine = runs == run
            own, to = src[mine], dst[mine]
            yield block(run, False, len(to), to.astype("<i4"))
            # nodes before the batch's last one are complete
            high = int(own[-1])
            if high > node:
                low, places = node, np.searchsorted(own, np.arange(node, min(high, node + BLOCK)), "right")
                while low < high:
                    yield block(run, True, 0, (upto + places).astype("<u8"))
                    low += len(places)
                    places = np.searchsorted(own, np.arange(low, min(high, low + BLOCK)), "right")
                node = high
            upto += len(to)
    if now >= 0:
        yield from ends(now, upto, node, lasts[now])
