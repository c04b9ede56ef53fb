"""Text files by byte ranges: a data source whose partitions are ranges, samples of seeded fragments, and heads of files.

A line belongs to the range in which it begins. A range begins a byte early and passes over what belongs to the range before
it, and reads on past its end to the end of its last line, so lines of any length come whole and once. Beside the ranges
themselves a reader touches at most a line and a block at each end.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from weft.functions.exprs import label_and_text
from weft.session import parallelism, ship

#: Bytes that are asked for at a time inside a range and beyond its end.
BLOCK, MARGIN = 1 << 20, 1 << 12


def file_system(path: str):
    """(file system, path in it) of a path or URI that PyArrow can open."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in order of name; hidden ones and those that begin with _ are no data."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner))
    found = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted((head + f.path, f.size) for f in found)


def even_ranges(files: list[tuple[str, int]], n: int) -> list[tuple[str, int, int]]:
    """About n ranges (file, start, stop) of equal length that cover all files; a range lies in one file."""
    total = sum(size for _, size in files)
    step = max(1, -(-total // max(n, 1)))
    return [(f, a, min(a + step, size)) for f, size in files for a in range(0, size, step)]


def fragment_ranges(files: list[tuple[str, int]], n: int, length: int, seed: int) -> list[tuple[str, int, int]]:
    """n fragments of `length` bytes at seeded places, one in each n-th of all bytes, so none overlap; all bytes if the
    fragments would cover them."""
    total = sum(size for _, size in files)
    share = total / max(n, 1)
    if share <= length:
        return even_ranges(files, n)
    rng = random.Random(seed)
    places = [int(i * share + rng.random() * (share - length)) for i in range(n)]
    out, begin = [], 0
    for f, size in files:
        # a fragment that passes the end of its file goes on in the next one
        out += [(f, max(p - begin, 0), min(p + length - begin, size)) for p in places if p < begin + size and p + length > begin]
        begin += size
    return out


def range_lines(stream, start: int, stop: int, size: int, block: int = BLOCK, margin: int = MARGIN) -> Iterator[tuple[int, bytes, int]]:
    """(offset, line, bytes read so far) of the lines that begin in [start, stop); line feeds end lines and aren't part."""
    if start >= stop:
        return
    at = max(start - 1, 0)
    stream.seek(at)
    held, offset, read = b"", at, 0
    skipping = start > 0
    while True:
        here = offset + len(held)
        want = min(block, stop - here) if here < stop else min(margin, size - here)
        more = stream.read(want) if want > 0 else b""
        read += len(more)
        last = not more
        held += more
        if skipping:
            end = held.find(b"\n")
            if end < 0:
                # the line before goes on
                offset, held = offset + len(held), b""
                if last or offset >= stop:
                    return
                continue
            held, offset, skipping = held[end + 1 :], offset + end + 1, False
        *lines, held = held.split(b"\n")
        for line in lines:
            if offset >= stop:
                return
            yield offset, line, read
            offset += len(line) + 1
        if offset >= stop:
            return
        if last:
            if held:
                yield offset, held, read
            return


class ByteRange(InputPartition):
    def __init__(self, number: int, path: str, start: int, stop: int, size: int):
        super().__init__(number)
        self.number, self.path, self.start, self.stop, self.size = number, path, start, stop, size


LINES = "file string, range int, offset long, line binary"
REPORT = "file string, range int, start long, stop long, lines long, line_bytes long, bytes_read long"


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.report = options["path"], options.get("report") == "true"
        self.ranges, self.fragments = int(options.get("ranges", "8")), options.get("fragments")
        self.length, self.seed = int(options.get("length", str(1 << 16))), int(options.get("seed", "0"))
        self.window = (int(options.get("from", "0")), options.get("upto"))

    def partitions(self) -> list[ByteRange]:
        files = list_files(self.path)
        sizes = dict(files)
        if self.fragments:
            found = fragment_ranges(files, int(self.fragments), self.length, self.seed)
        elif self.window[1] is None:
            found = even_ranges(files, self.ranges)
        else:
            # bytes from .. upto of all files in order of name
            begin, cut = 0, []
            for f, size in files:
                a, b = max(self.window[0] - begin, 0), min(int(self.window[1]) - begin, size)
                step = max(1, -(-(int(self.window[1]) - self.window[0]) // self.ranges))
                cut += [(f, x, min(x + step, b)) for x in range(a, b, step)]
                begin += size
            found = cut
        return [ByteRange(i, f, a, b, sizes[f]) for i, (f, a, b) in enumerate(found)] or [ByteRange(0, "", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        p = partition
        fs, inner = file_system(p.path) if p.path else (None, None)
        lines = size = read = 0
        offsets, rows, held = [], [], 0

        def batch():
            n = len(rows)
            columns = [pa.array([p.path] * n, pa.string()), pa.array([p.number] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(rows, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "range", "offset", "line"])

        if p.path:
            with fs.open_input_file(inner) as stream:
                for offset, line, read in range_lines(stream, p.start, p.stop, p.size):
                    lines, size = lines + 1, size + len(line) + 1
                    if not self.report:
                        offsets.append(offset)
                        rows.append(line)
                        held += len(line)
                        if len(rows) >= 4096 or held >= 1 << 22:
                            yield batch()
                            offsets, rows, held = [], [], 0
        if not self.report:
            yield batch()
        elif p.path:
            told = (p.path, p.number, p.start, p.stop, lines, size, read)
            kinds = [pa.string(), pa.int32()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(told, kinds)], names=[c.split()[0] for c in REPORT.split(", ")])


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_lines"

    def schema(self) -> str:
        return REPORT if self.options.get("report") == "true" else LINES

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def _load(spark: SparkSession, path: str, **options) -> DataFrame:
    ship()
    spark.dataSource.register(LineSource)
    return spark.read.format("weft_lines").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(path)


def read_lines(spark: SparkSession, path: str, ranges: int, report: bool = False) -> DataFrame:
    """(file, range, offset, line) of all lines of a file or folder, read in about `ranges` byte ranges of equal length; with
    `report` a row for each range and what it read instead."""
    return _load(spark, path, ranges=ranges, report=report)


def read_fragments(spark: SparkSession, path: str, n: int, length: int, seed: int = 0, report: bool = False) -> DataFrame:
    """As read_lines, of the lines that begin in n seeded fragments of `length` bytes; no other part of the files is read."""
    return _load(spark, path, fragments=n, length=length, seed=seed, report=report)


def read_range_table(spark: SparkSession, path: str, n_columns: int, ranges: int, delimiter: str = ",") -> DataFrame:
    """A headerless, unquoted table of strings, columns c0, c1, .., read by byte ranges; missing fields are null."""
    fields = F.split(F.col("line").cast("string"), re.escape(delimiter), -1)
    return read_lines(spark, path, ranges).select(*[F.get(fields, F.lit(i)).alias(f"c{i}") for i in range(n_columns)])


def read_reviews_head(spark: SparkSession, path: str, mib: float, ranges: int | None = None) -> tuple[DataFrame, int]:
    """((file, offset, label, text, before), bytes): labelled lines in order of file and place until their texts' characters
    exceed `mib` MiB; the line that crosses the limit still counts. `before` are the characters before it.

    Ranges of bytes are read in rounds, the first as long as the limit, each later one twice as long as the one before, and
    none after the round in which the limit is passed: at most about three times the bytes that were needed. Sums of the
    ranges are made first; the rows of a range are summed in that range.
    """
    total, limit = sum(size for _, size in list_files(path)), int(mib * 2**20)
    n = ranges or parallelism(spark)
    upto, length, chars = 0, max(limit, n), 0
    rounds, sizes = [], []
    while upto < total and chars <= limit:
        window = (upto, min(upto + length, total))
        label, text = label_and_text(F.col("line").cast("string"))
        rows = _load(spark, path, ranges=n, **{"from": window[0], "upto": window[1]}).select("file", (F.col("range") + n * 1000 * len(rounds)).alias("part"), "offset", label.alias("label"), text.alias("text")).where("label is not null")
        found = rows.groupBy("part").agg(F.sum(F.length("text")).alias("n")).collect()
        sizes += [(r["part"], r["n"]) for r in found]
        rounds.append(rows)
        chars += sum(r["n"] for r in found)
        upto, length = window[1], 2 * length
    if not rounds:
        empty = spark.createDataFrame([], "file string, offset long, label int, text string, before long")
        return empty, 0
    # a row for each range that was read
    starts, at = [], 0
    for part, n_chars in sorted(sizes):
        starts.append((part, at))
        at += n_chars
    rows = rounds[0]
    for more in rounds[1:]:
        rows = rows.union(more)
    ahead = F.broadcast(spark.createDataFrame([s for s in starts if s[1] <= limit], "part int, start long"))
    inside = Window.partitionBy("part").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(ahead, "part").withColumn("before", (F.col("start") + F.coalesce(F.sum(F.length("text")).over(inside), F.lit(0))).cast("long"))
    return out.where(F.col("before") <= limit).select("file", "offset", "label", "text", "before"), upto
