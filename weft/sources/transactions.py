"""Delimited text in numbered parts, written all or not at all: a data source writer with commit, abort and a manifest.

Tasks write below a staging folder of the transaction, each attempt a file of its own. Commit moves the files that Spark
took the messages of to their numbered names and then replaces the manifest, in one move; readers go by the manifest alone.
What failed, repeated or abandoned attempts leave behind is never in it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from weft.session import ship
from weft.sources.byteranges import file_system

MANIFEST, STAGING = "_manifest.json", "_staging-"


@dataclass
class PartMessage(WriterCommitMessage):
    """A task's file in the staging folder, what it holds and the partition that it came from."""

    partition: int
    name: str
    rows: int
    bytes: int


def read_manifest(path: str) -> dict:
    """{"version", "columns", "parts"}; parts in order, each with name, rows and bytes. Version 0 without parts if nothing has
    been committed."""
    fs, inner = file_system(path)
    if fs.get_file_info(f"{inner}/{MANIFEST}").type == pafs.FileType.NotFound:
        return {"version": 0, "columns": [], "parts": []}
    with fs.open_input_stream(f"{inner}/{MANIFEST}") as f:
        return json.loads(f.read())


def delimited(batch: pa.RecordBatch, delimiter: str) -> bytes:
    """A line for each row; nulls are empty fields."""
    fields = [pc.fill_null(c.cast(pa.string()), "") for c in batch.columns]
    joined = pc.binary_join_element_wise(*fields, delimiter) if len(fields) > 1 else fields[0]
    return "".join(f"{x}\n" for x in joined.to_pylist()).encode()


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.path, self.delimiter = options["path"], options.get("delimiter", ",")
        self.columns, self.overwrite = schema.names, overwrite
        self.txn = uuid.uuid4().hex
        self.base = read_manifest(self.path)["version"]

    def _staging(self, inner: str) -> str:
        return f"{inner}/{STAGING}{self.txn}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartMessage:
        task = TaskContext.get()
        return self.write_attempt(iterator, task.partitionId(), task.taskAttemptId())

    def write_attempt(self, batches: Iterator[pa.RecordBatch], partition: int, attempt: int) -> PartMessage:
        fs, inner = file_system(self.path)
        fs.create_dir(self._staging(inner), recursive=True)
        name, rows, size = f"{partition:05d}-{attempt}", 0, 0
        with fs.open_output_stream(f"{self._staging(inner)}/{name}") as out:
            for batch in batches:
                data = delimited(batch, self.delimiter)
                out.write(data)
                rows, size = rows + batch.num_rows, size + len(data)
        return PartMessage(partition, name, rows, size)

    def commit(self, messages: list[PartMessage | None]) -> None:
        fs, inner = file_system(self.path)
        before = read_manifest(self.path)
        if before["version"] != self.base:
            self.abort(messages)
            raise RuntimeError(f"{self.path} was changed by another writer: version {before['version']}, not {self.base}")
        kept = [] if self.overwrite else before["parts"]
        if kept and before["columns"] != self.columns:
            self.abort(messages)
            raise ValueError(f"{self.path} has columns {before['columns']}, not {self.columns}")
        parts = []
        # empty partitions have no part
        for number, m in enumerate(sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition), len(kept)):
            name = f"part-{number:05d}-{self.txn[:8]}"
            fs.move(f"{self._staging(inner)}/{m.name}", f"{inner}/{name}")
            parts.append({"name": name, "rows": m.rows, "bytes": m.bytes})
        manifest = {"version": self.base + 1, "columns": self.columns, "parts": kept + parts}
        fs.create_dir(inner, recursive=True)
        with fs.open_output_stream(f"{inner}/{STAGING}{self.txn}.json") as f:
            f.write(json.dumps(manifest).encode())
        # from here on readers see the new parts
        fs.move(f"{inner}/{STAGING}{self.txn}.json", f"{inner}/{MANIFEST}")
        self._remove_staging(fs, inner)
        if self.overwrite:
            for p in before["parts"]:
                fs.delete_file(f"{inner}/{p['name']}")

    def abort(self, messages: list[PartMessage | None]) -> None:
        self._remove_staging(*file_system(self.path))

    def _remove_staging(self, fs, inner: str) -> None:
        if fs.get_file_info(self._staging(inner)).type == pafs.FileType.Directory:
            fs.delete_dir(self._staging(inner))


class PartSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weft_parts"

    def writer(self, schema: T.StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.options, schema, overwrite)


def write_parts(df: DataFrame, path: str, overwrite: bool = False, delimiter: str = ",") -> None:
    """df's rows as parts in the order of its partitions, beside earlier ones or instead of them. Columns are written as text
    and not quoted, so values may not hold the delimiter or line feeds."""
    ship()
    df.sparkSession.dataSource.register(PartSource)
    df.write.format("weft_parts").option("delimiter", delimiter).mode("overwrite" if overwrite else "append").save(path)


def read_parts(spark: SparkSession, path: str, schema: str, delimiter: str = ",") -> DataFrame:
    """The rows of the parts in the manifest, with the given columns in order; a field that doesn't fit its type is an error."""
    names = [f"{path}/{p['name']}" for p in read_manifest(path)["parts"]]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.csv(names, schema=schema, sep=delimiter, quote="", escape="", mode="FAILFAST")


def orphans(path: str) -> list[str]:
    """Names in the folder that the manifest doesn't know: staging folders, parts of abandoned commits."""
    fs, inner = file_system(path)
    known = {p["name"] for p in read_manifest(path)["parts"]} | {MANIFEST}
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.base_name not in known)


def clean_orphans(path: str) -> list[str]:
    """Deletes orphans, of a folder that nobody writes to now; gives their names."""
    fs, inner = file_system(path)
    found = orphans(path)
    for name in found:
        if fs.get_file_info(f"{inner}/{name}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{inner}/{name}")
        else:
            fs.delete_file(f"{inner}/{name}")
    return found
