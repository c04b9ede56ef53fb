"""Web archives: ARC files of either version written and parsed, their records converted to WARC, WARC read back.

Archives are gzip files that Spark writes and reads as lines of bytes, so any file system that Spark knows will do. A
gzip file isn't split: its lines reach one task in order, and records are put together from as many bytes as their headers
declare. No task holds more than a batch of lines and the record in hand.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import FEW, map_batches, read, text_bytes
from weft.session import materialize, shared_dir

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Field names of the header lines, as an archive's own version block declares them. Fixed values of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value of the format: the profile of records that stand for an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records whose source has none.
NO_DATE = "19700101000000"


def _save(records: DataFrame, path: str) -> None:
    """Rows of bytes as gzip files, each row followed by a line feed. Bytes pass as they are, UTF-8 or not."""
    out = records.select(F.col("record").cast("string").alias("value"))
    out.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of gzip archives, each file's lines in order."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("value").cast("binary").alias("line"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _safe(url: str | None) -> str:
    """A URL as one field of a header line: white space and control characters as percent escapes, "-" for none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "") or "-"


def arc_header(version: int, url: str | None, ip: str, date: str, kind: str, length: int, status: str = "200", digest: str = "-", archive: str = "-") -> bytes:
    """A record's header line without its line feed."""
    first = f"{_safe(url)} {ip} {date} {kind}"
    return (f"{first} {length}" if version == 1 else f"{first} {status} {digest} - 0 {archive} {length}").encode()


def arc_preamble(version: int, archive: str, date: str = NO_DATE) -> bytes:
    """The record that begins an archive: its name and the version block with the names of the header lines' fields."""
    block = f"{version} 0 weft\n{ARC_FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{archive}", "0.0.0.0", date, "text/plain", len(block), archive=archive) + b"\n" + block


def write_arc(pages: DataFrame, path: str, id_col: str, url_col: str, body_col: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """Rows of pages as ARC records in `path`, an archive for each partition, versions taken in turn.

    A record holds an HTTP response whose payload is the body in UTF-8 (null: empty); the id travels in its X-Record field
    (null: without). Null URLs are written as "-". A partition without rows has no archive.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{url_col}`").cast("string").alias("u"), F.col(f"`{body_col}`").cast("string").alias("b"))

    def run(batches):
        part = TaskContext.get().partitionId()
        version, archive, begun = versions[part % len(versions)], f"weft-{part:05d}.arc", False
        for batch in batches:
            out = []
            if not begun and batch.num_rows:
                out.append(arc_preamble(version, archive))
                begun = True
            for i, u, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                own = f"X-Record: {i}\r\n" if i is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n".encode()
                out.append(arc_header(version, u, "0.0.0.0", NO_DATE, "text/html", len(head) + len(body), archive=archive) + b"\n" + head + body)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _save(map_batches(rows, run, "record binary"), path)


class Block:
    """Collects the lines of a block until as many bytes as were declared are there."""

    def __init__(self, length: int):
        self.length, self.have, self.parts = length, 0, []

    def add(self, line: bytes) -> None:
        self.parts.append(line)
        self.have += len(line) + 1

    @property
    def done(self) -> bool:
        return self.have >= self.length

    def take(self, end: bytes) -> bytes:
        """The block; after it may come `end` or, if it ends with a line feed, nothing on its last line."""
        whole = b"\n".join(self.parts) + b"\n" if self.parts else b""
        if whole[self.length :] not in (b"", end):
            raise ValueError(f"a record goes on beyond its {self.length} declared bytes")
        return whole[: self.length]


def arc_records(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[dict[str, str], bytes, str, int]]:
    """(fields, content, archive, place) of each record of ARC files, whose lines come file by file.

    The version block at a file's beginning says which fields its header lines have. A header line of other fields, a
    length that isn't a number, content that is longer or shorter than declared, and a file without a version block are
    errors. Blank lines between records are allowed.
    """
    file, names, archive, place, fields, block = None, [], "", 0, None, None
    for here, line in lines:
        if here != file:
            if block is not None:
                raise ValueError(f"{archive}: the last record is cut short")
            file, names, place = here, [], 0
        if block is None:
            if not line.strip():
                continue
            text = line.decode("utf-8", "surrogateescape").rstrip("\r")
            if not names and not text.startswith("filedesc://"):
                raise ValueError("an archive must begin with its version block")
            keys = names or text.split(" ")
            values = text.rsplit(" ", len(keys) - 1)
            if len(values) != len(keys) or not values[-1].isdecimal():
                raise ValueError(f"no header line: {text[:200]!r}")
            fields, block = dict(zip(names, values)) or {"URL": values[0], "Archive-date": values[2]}, Block(int(values[-1]))
        else:
            block.add(line)
        if block.done:
            content = block.take(b"\n")
            if not names:
                archive = fields["URL"].removeprefix("filedesc://")
                names = content.decode().split("\n")[1].split(" ")
            yield fields, content, archive, place
            place, block = place + 1, None
    if block is not None:
        raise ValueError(f"{archive}: the last record is cut short")


def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload) of an HTTP message; content that isn't one is payload alone."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    head, end, payload = content.partition(b"\r\n\r\n")
    return head + end, payload


def _http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return found.group(1).decode("utf-8", "replace") if found else None


def warc_date(date: str) -> str:
    """The date of an ARC header, of 14 digits or the first 4, 6, 8, 10 or 12 of them, in the form of WARC."""
    if not re.fullmatch(r"\d{4}(\d\d){0,5}", date):
        date = NO_DATE
    d = date + "0101000000"[len(date) - 4 :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


RECORD = "kind string, record_id string, id string, date string, url string, ip string, mime string, payload_bytes bigint, payload_digest string, head binary, payload binary"


def read_arc(spark: SparkSession, path: str, narrow: bool = False) -> DataFrame:
    """Records of ARC files with what their WARC counterparts need: type, identifier, date, digest and so on.

    Version blocks become warcinfo records, HTTP responses response records, all else resource records. Identifiers are
    UUIDs from the archive's name, the record's place, URL, date and digest, the same on every run. `narrow` leaves out
    header and payload (null).
    """

    def run(batches):
        rows = []
        size = 0
        for fields, content, archive, place in arc_records(_pairs(batches)):
            head, payload = _split_http(content)
            url, date = fields["URL"], warc_date(fields["Archive-date"])
            digest = hashlib.sha256(payload).hexdigest()
            name = hashlib.sha256("\n".join([archive, str(place), url, date, digest]).encode("utf-8", "surrogateescape")).digest()
            kind = "warcinfo" if url.startswith("filedesc://") else "response" if head else "resource"
            url = None if url == "-" else url.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            rows.append((kind, f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>", _http_field(head, "X-Record"), date, url, fields.get("IP-address"), fields.get("Content-type"), len(payload), digest, None if narrow else head, None if narrow else payload))
            size += 0 if narrow else len(content)
            if len(rows) >= 512 or size >= 1 << 24:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return map_batches(_lines(spark, path), run, RECORD)


def with_revisits(records: DataFrame, narrow: DataFrame) -> DataFrame:
    """records with refers_to, refers_url and refers_date: of responses with equal payloads of at least LEAST bytes, all
    but the first by id (as a number, then as text, none last; then by identifier) refer to that one.

    `narrow` has the same records without payloads. Only digests that occur twice are looked up: a row for each group of
    copies, sent to all tasks up to FEW of them, so payloads stay where they are; beyond that both sides are shuffled.
    """
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").try_cast("long").alias("n"), F.col("id").alias("i"), F.col("record_id").alias("refers_to"), F.col("url").alias("refers_url"), F.col("date").alias("refers_date"))
    groups = narrow.where((F.col("kind") == "response") & (F.col("payload_bytes") >= LEAST)).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    groups = materialize(groups.where("n > 1").select("payload_digest", "first.refers_to", "first.refers_url", "first.refers_date"))
    if groups.limit(FEW + 1).count() <= FEW:
        groups = F.broadcast(groups)
    both = records.join(groups, "payload_digest", "left")
    own = (F.col("kind") == "response") & (F.col("payload_bytes") >= LEAST) & (F.col("refers_to") != F.col("record_id"))
    names = ("refers_to", "refers_url", "refers_date")
    return both.select(*records.columns, *[F.when(own, F.col(c)).alias(c) for c in names])


def write_warc(records: DataFrame, path: str) -> None:
    """records (of with_revisits) as WARC 1.1 files. A revisit holds the header of its response and no payload; its
    X-Payload-Length field keeps the payload's length."""
    rows = records.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))

    def record(r) -> bytes:
        revisit = r["refers_to"] is not None
        block = (r["head"] or b"") + (r["payload"] or b"")
        kind = "revisit" if revisit else r["kind"]
        mime = "application/http;msgtype=response" if kind in ("response", "revisit") else "application/warc-fields" if kind == "warcinfo" else r["mime"]
        fields = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", r["record_id"]),
            ("WARC-Date", r["date"]),
            ("WARC-Target-URI", r["url"] if kind != "warcinfo" else None),
            ("WARC-Filename", r["url"].removeprefix("filedesc://") if kind == "warcinfo" else None),
            ("WARC-IP-Address", r["ip"] if r["ip"] not in (None, "0.0.0.0") else None),
            ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
            ("WARC-Payload-Digest", "sha256:" + r["payload_digest"] if kind != "warcinfo" else None),
            ("WARC-Refers-To", r["refers_to"]),
            ("WARC-Refers-To-Target-URI", r["refers_url"]),
            ("WARC-Refers-To-Date", r["refers_date"]),
            ("WARC-Profile", PROFILE if revisit else None),
            ("X-Payload-Length", str(r["payload_bytes"]) if revisit else None),
            ("Content-Type", mime),
            ("Content-Length", str(len(block))),
        ]
        # with the line feed that the writer adds, a record ends in two line ends
        return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode() + block + b"\r\n\r"

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([record(r) for r in batch.to_pylist()], pa.binary())], names=["record"])

    _save(map_batches(rows, run, "record binary"), path)


def warc_records(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of WARC files, whose lines come file by file; field names in lower case."""
    file, fields, block = None, None, None
    for here, line in lines:
        if here != file:
            if fields is not None:
                raise ValueError("the last record of an archive is cut short")
            file = here
        if block is not None:
            block.add(line)
        elif fields is None:
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins here: {line[:200]!r}")
            fields = {}
        elif line in (b"\r", b""):
            block = Block(int(fields["content-length"]))
        else:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        if block is not None and block.done:
            yield fields, block.take(b"\r\n")
            fields, block = None, None
    if fields is not None:
        raise ValueError("the last record of an archive is cut short")


READ = "kind string, record_id string, id string, url string, date string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of WARC files. The digests of blocks and of payloads that are there must be as declared, else it is an
    error; those of a revisit's payload come from its fields. Payloads only on demand (else null)."""

    def check(fields: dict[str, str], name: str, data: bytes) -> str:
        found, told = hashlib.sha256(data).hexdigest(), fields.get(name)
        if told is not None and told != "sha256:" + found:
            raise ValueError(f"{fields.get('warc-record-id')}: {name} is not that of the data")
        return found

    def run(batches):
        rows, size = [], 0
        for fields, block in warc_records(_pairs(batches)):
            kind = fields["warc-type"]
            check(fields, "warc-block-digest", block)
            head, payload = _split_http(block) if "application/http" in fields.get("content-type", "") else (b"", block)
            if kind == "revisit":
                n, digest, payload = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), None
            else:
                n, digest = len(payload), check(fields, "warc-payload-digest", payload)
            rows.append((kind, fields["warc-record-id"], _http_field(head, "X-Record"), fields.get("warc-target-uri"), fields["warc-date"], fields.get("warc-refers-to"), n, digest, payload if with_payload else None))
            size += len(payload or b"") if with_payload else 0
            if len(rows) >= 512 or size >= 1 << 24:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in READ.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return map_batches(_lines(spark, path), run, READ)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """ARC files to WARC files: a record for each, in as many archives, equal payloads as revisits."""
    write_warc(with_revisits(read_arc(spark, arc_path), read_arc(spark, arc_path, narrow=True)), warc_path)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records (of read_warc) with refers_id, the id of the record that each revisit refers to."""
    wanted = records.where("refers_to is not null").select("refers_to").distinct()
    ids = records.where("kind <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("id").alias("refers_id"))
    found = materialize(ids.join(wanted, "refers_to", "left_semi"))
    if found.limit(FEW + 1).count() <= FEW:
        found = F.broadcast(found)
    return records.join(found, "refers_to", "left")


def op13_arc_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: what its WARC record says after the page went to an ARC file and that was converted.

    A null html is an empty payload; null URLs pass. Pages without an id are taken last among equal payloads; rows that
    repeat id and payload are records of their own, one of which is the response. Columns other than the three aren't read.
    """
    base = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    write_arc(read(spark, sf_dir, "pages"), f"{base}-arc", "page_id", "url", "html")
    convert_arc(spark, f"{base}-arc", f"{base}-warc")
    records = materialize(read_warc(spark, f"{base}-warc").drop("payload").where("kind in ('response', 'revisit')"))
    found = resolve_revisits(records)
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_id").cast("long").alias("refers_to"))
