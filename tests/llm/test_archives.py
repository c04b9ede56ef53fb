import hashlib
import random

import pytest

from tests.llm.helpers import prose
from weft.llm import archives

PAGES = "page_id long, url string, html string, kind string, payload binary"


def lines(data: bytes, file: int = 0):
    """Lines as Spark reads them: what follows the last line feed only if there is something."""
    parts = data.split(b"\n")
    return [(file, p) for p in (parts[:-1] if not parts[-1] else parts)]


def test_either_version_by_declared_lengths():
    for version, rest in ((1, b""), (2, b" 200 - - 0 x.arc")):
        body = b"HTTP/1.0 200 OK\r\nX-Record: 5\r\n\r\nhttp://not.a/header 0.0.0.0 1 text/html 3\nabc\n\n"
        data = archives.arc_preamble(version, "x.arc", "1996") + b"\n"
        for url, kind, content in ((b"http://a b/", b"text/html", body), (b"dns:a", b"text/dns", b""), (b"-", b"text/plain", b"\xff\xfe"), (b"http://c/", b"text/html", b"tail\n")):
            data += url + b" 1.2.3.4 19960102030405 " + kind + rest + b" %d\n" % len(content) + content + b"\n"
        found = list(archives.arc_records(iter(lines(data))))
        assert [c for _, c, _, _ in found[1:]] == [body, b"", b"\xff\xfe", b"tail\n"]
        assert [f["URL"] for f, *_ in found[1:]] == ["http://a b/", "dns:a", "-", "http://c/"]
        assert all(f["Archive-date"] == "19960102030405" and f["IP-address"] == "1.2.3.4" for f, *_ in found[1:])
        assert {a for _, _, a, _ in found} == {"x.arc"} and [p for *_, p in found] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("data", [
    b"http://a 1 2 t 3\nabc\n",
    archives.arc_preamble(1, "x") + b"\nhttp://a 1 2 t 30\nabc\n",
    archives.arc_preamble(1, "x") + b"\nhttp://a 1 2 t 2\nabc\n",
    archives.arc_preamble(1, "x") + b"\nhttp://a 1 2 t many\nabc\n",
    archives.arc_preamble(2, "x") + b"\nhttp://a 1 2 t 3\nabc\n",
])
def test_broken_archives_are_errors(data):
    with pytest.raises(ValueError):
        list(archives.arc_records(iter(lines(data))))


def test_dates():
    assert archives.warc_date("19970102030405") == "1997-01-02T03:04:05Z"
    assert archives.warc_date("1997") == "1997-01-01T00:00:00Z"
    assert archives.warc_date("199702030405") == "1997-02-03T04:05:00Z"
    assert archives.warc_date("19970") == archives.warc_date("none") == "1970-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(3)
    long = [prose(rng, 40) for _ in range(5)]
    bodies = [long[0], long[0], None, "", "short", "short", long[1] + "\r\n\r\nHTTP/1.1 \n\nWARC/1.1\r\n", "é" * 49, "é" * 49, "é" * 50, "é" * 50, "\n" * 120, "\n" * 120, "x" * 300_000, long[2] + "\r", "\x00" * 100]
    rows = [(i, f"http://h/{i}?a b\n", b, "kept", b"z") for i, b in enumerate(bodies)]
    return rows + [(None, None, long[0], None, None), (40, "http://x/", long[3], None, None), (40, "http://x/", long[3], None, None), (None, "u", long[4], None, None), (9, "http://y", long[4], None, None), (10, "http://y", long[4], None, None)]


def brute(rows):
    firsts = {}
    for i, _, html, *_ in rows:
        firsts.setdefault(html or "", []).append(i)
    out = []
    for html, ids in firsts.items():
        raw = html.encode()
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(ids):
            again = n > 0 and len(raw) >= 100
            out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(map(repr, out))


def test_query(spark, pages, tmp_path):
    spark.createDataFrame(pages, PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = archives.op13_arc_converter(spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == brute(pages)


def test_shuffled_when_groups_are_many(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "FEW", 1)
    spark.createDataFrame(pages, PAGES).repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    found = archives.op13_arc_converter(spark, str(tmp_path))
    assert sorted(repr(tuple(r)) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == brute(pages)


def test_archives_hold_the_pages(spark, pages, tmp_path):
    arc, warc = f"{tmp_path}/arc", f"{tmp_path}/warc"
    archives.write_arc(spark.createDataFrame(pages, PAGES).repartition(2), arc, "page_id", "url", "html")
    records = archives.read_arc(spark, arc).collect()
    assert sorted(r["payload"].decode() for r in records if r["kind"] == "response") == sorted(p[2] or "" for p in pages)
    assert sum(r["kind"] == "warcinfo" for r in records) == 2
    archives.convert_arc(spark, arc, warc)
    back = archives.read_warc(spark, warc, with_payload=True).collect()
    assert len(back) == len(records) and len({r["record_id"] for r in back}) == len(back)
    assert {r["record_id"]: r["payload_digest"] for r in back} == {r["record_id"]: r["payload_digest"] for r in records}
    kept = {r["record_id"] for r in back if r["kind"] == "response"}
    for r in back:
        assert (r["payload"] is None) == (r["kind"] == "revisit") == (r["refers_to"] is not None)
        assert r["refers_to"] is None or r["refers_to"] in kept
    assert {r["url"] for r in back if r["kind"] == "response" and r["id"] == "2"} == {"http://h/2?a%20b%0A"}


def test_a_changed_payload_is_an_error(spark, pages, tmp_path):
    archives.write_arc(spark.createDataFrame(pages[:1], PAGES), f"{tmp_path}/arc", "page_id", "url", "html")
    records = archives.read_arc(spark, f"{tmp_path}/arc")
    wrong = archives.with_revisits(records, records).withColumn("payload_digest", records.record_id)
    archives.write_warc(wrong, f"{tmp_path}/warc")
    with pytest.raises(Exception, match="payload-digest"):
        archives.read_warc(spark, f"{tmp_path}/warc").collect()


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert archives.op13_arc_converter(spark, str(tmp_path)).collect() == []
