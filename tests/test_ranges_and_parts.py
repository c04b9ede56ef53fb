import io
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators import sort
from weft.operators.sketch import KeySketch, key_sketch
from weft.sources import byteranges, transactions


def cut(data: bytes):
    """(offset, line) of all lines."""
    out, at = [], 0
    for line in data.split(b"\n"):
        out.append((at, line))
        at += len(line) + 1
    return out[:-1] if not out[-1][1] else out


def test_each_line_lies_in_one_range():
    rng = random.Random(1)
    for _ in range(2000):
        data = b"".join(bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(8)))
        found = []
        for _, a, b in byteranges.even_ranges([("x", len(data))], rng.randrange(1, 9)):
            found += [(o, line) for o, line, _ in byteranges.range_lines(io.BytesIO(data), a, b, len(data), rng.randrange(1, 5), rng.randrange(1, 5))]
        assert found == cut(data)


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Two files with lines of any length, the last one without a line feed; a hidden file."""
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("lines")
    rows = [f"{i},{'é' * rng.choice([0, 1, 5, 40])}{'x' * (20_000 if i % 211 == 0 else 3)},{i % 7}" for i in range(2000)]
    (folder / "a.csv").write_text("\n".join(rows[:900]) + "\n")
    (folder / "b.csv").write_text("\n".join(rows[900:]))
    (folder / "_SUCCESS").write_text("no data\n")
    return folder, rows


@pytest.mark.parametrize("ranges", [1, 7, 50])
def test_table_by_ranges(spark, lines, ranges):
    folder, rows = lines
    found = byteranges.read_range_table(spark, str(folder), 4, ranges).collect()
    assert sorted(tuple(r) for r in found) == sorted((*r.split(","), None) for r in rows)
    report = byteranges.read_lines(spark, str(folder), ranges, report=True).collect()
    total = sum(os.path.getsize(folder / f) for f in ("a.csv", "b.csv"))
    assert sum(r["lines"] for r in report) == 2000 and sum(r["line_bytes"] for r in report) == total + 1
    # beside its own bytes a range reads one before, and at most a line and a block behind
    assert all(r["bytes_read"] <= r["stop"] - r["start"] + 1 + 20_200 + byteranges.MARGIN for r in report)
    assert total <= sum(r["bytes_read"] for r in report)


def test_fragments_read_no_more_than_themselves(spark, lines):
    folder, rows = lines
    found = byteranges.read_fragments(spark, str(folder), 10, 600, seed=3).collect()
    report = byteranges.read_fragments(spark, str(folder), 10, 600, seed=3, report=True).collect()
    assert 0 < len(found) == sum(r["lines"] for r in report) == len({(r["file"], r["offset"]) for r in found})
    assert {bytes(r["line"]).decode() for r in found} <= set(rows)
    assert sum(r["stop"] - r["start"] for r in report) == 6000
    assert sum(r["bytes_read"] for r in report) <= 10 * (600 + 1 + 20_200 + byteranges.MARGIN)
    again = byteranges.read_fragments(spark, str(folder), 10, 600, seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert len(byteranges.read_fragments(spark, str(folder), 10, 1 << 20).collect()) == 2000


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    assert byteranges.read_lines(spark, str(tmp_path), 3).collect() == []
    assert byteranges.read_fragments(spark, str(tmp_path), 3, 10).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        byteranges.read_lines(spark, str(tmp_path / "nowhere"), 3).collect()


def test_head_of_reviews_stops_early(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2]), "wörd " * rng.randrange(60)) for _ in range(3000)]
    for n in range(3):
        (tmp_path / f"part-{n}").write_text("".join(f"__label__{a} {t}\n" if i % 50 else "no label here\n" for i, (a, t) in enumerate(rows[n * 1000 : n * 1000 + 1000])))
    kept = [r for i, r in enumerate(rows) if i % 1000 % 50]
    for mib in (0, 0.01, 0.1, 10):
        found, read = byteranges.read_reviews_head(spark, str(tmp_path), mib, ranges=3)
        got = sorted(found.collect(), key=lambda r: r["before"] + (r["text"] != "") / 2)
        want, before = [], 0
        for a, t in kept:
            if before > mib * 2**20:
                break
            want.append((a - 1, t, before))
            before += len(t)
        assert sorted((r["label"], r["text"], r["before"]) for r in got) == sorted(want)
        total = sum(os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path))
        assert read <= max(4 * sum(len(t.encode()) + 12 for _, t, _ in want), 8) or read == total
    none, read = byteranges.read_reviews_head(spark, str(tmp_path / "part-0"), 0.001)
    assert read < 20_000 and none.count() > 3


def test_sketch_keeps_within_its_error():
    rng = random.Random(5)
    for n, keys in ((40_000, lambda i: f"{rng.randrange(10**8):08d}"), (40_000, lambda i: f"{i:08d}"), (40_000, lambda i: rng.choice("abc")), (90, lambda i: str(i))):
        all_keys = [keys(i) for i in range(n)]
        one, other = KeySketch(128), KeySketch(128)
        one.add(all_keys[: n // 3])
        other.add(all_keys[n // 3 :])
        one.merge(other.error, other.levels)
        known = sorted(all_keys)
        assert one.n == n and one.error <= n / 128 * 12
        for p in range(0, n, n // 90):
            low, high = one.bracket(p)
            assert (low is None or low <= known[p]) and (high is None or known[p] <= high)
        for i, k in enumerate(one.quantiles(10), 1):
            place = int(i / 10 * n)
            assert known[max(place - one.error, 0)] <= k <= known[min(place + one.error, n - 1)]


def test_bounds_are_exact_in_two_passes_or_by_dealing(spark, monkeypatch):
    rng = random.Random(6)
    keys = [rng.choice([None, "hot", f"{rng.randrange(3000):05d}", "é" + str(rng.random())]) for _ in range(6000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(40)
    known = sorted((k for k in keys if k is not None), key=lambda k: k.encode())
    want = [known[int(i / 7 * len(known))] for i in range(1, 7)]
    sketch = key_sketch(df, F.col("k"), 64)
    assert sketch.error and sketch.n == len(known)
    exact = sort.quantile_bounds(df, F.col("k"), 7, room=64)
    assert exact.first()["bounds"] == want
    # all keys meet no exchange in a window: only what lies between brackets is sorted
    monkeypatch.setattr(sort, "WINDOW_KEYS", 1)
    assert sort.quantile_bounds(df, F.col("k"), 7, room=64).first()["bounds"] == want
    near = sort.planned_bounds(df, F.col("k"), 7, room=64).first()["bounds"]
    for i, k in enumerate(near, 1):
        p = int(i / 7 * len(known))
        assert known[max(p - sketch.error, 0)].encode() <= k.encode() <= known[min(p + sketch.error, len(known) - 1)].encode()


def test_bounds_from_fragments_are_even(spark, tmp_path):
    rng = random.Random(7)
    keys = [f"{rng.randrange(10**6):06d}" for _ in range(20_000)]
    (tmp_path / "t.csv").write_text("".join(f"x,{k},{'y' * rng.randrange(30)}\n" for k in keys))
    bounds = sort.fragment_bounds(spark, str(tmp_path), 1, 8, fragments=20, length=2000, seed=1).first()["bounds"]
    assert len(bounds) == 7 and bounds == sorted(bounds)
    sizes = [sum(1 for k in keys if (i == 0 or k > bounds[i - 1]) and (i == 7 or k <= bounds[i])) for i in range(8)]
    assert max(sizes) < 2 * 20_000 / 8 and sum(sizes) == 20_000


def batch(*rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["a", "b"])


SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_parts_in_order_appended_and_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(50).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), "id")).alias("b"))
    transactions.write_parts(df.repartitionByRange(4, "a").sortWithinPartitions("a"), path)
    first = transactions.read_manifest(path)
    assert first["version"] == 1 and [p["rows"] for p in first["parts"]] and sum(p["rows"] for p in first["parts"]) == 50
    text = "".join(open(f"{path}/{p['name']}").read() for p in first["parts"])
    assert [int(line.split(",")[0]) for line in text.splitlines()] == list(range(50))
    assert sum(p["bytes"] for p in first["parts"]) == len(text)
    transactions.write_parts(df.where("a < 5").coalesce(1), path)
    rows = transactions.read_parts(spark, path, "a long, b string")
    assert sorted(r["a"] for r in rows.collect()) == sorted([*range(50), *range(5)])
    assert [p["name"][:10] for p in transactions.read_manifest(path)["parts"]] == [f"part-{i:05d}" for i in range(len(first["parts"]) + 1)]
    transactions.write_parts(df.where("a >= 48"), path, overwrite=True)
    assert {(r["a"], r["b"]) for r in transactions.read_parts(spark, path, "a long, b string").collect()} == {(48, None), (49, "v49")}
    assert transactions.orphans(path) == []
    transactions.write_parts(df.where("a < 0"), path, overwrite=True)
    assert transactions.read_parts(spark, path, "a long, b string").collect() == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(10).select(F.col("id").alias("a"))
    transactions.write_parts(good, path)
    bad = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 990, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("a"))
    with pytest.raises(Exception, match="no"):
        transactions.write_parts(bad, path)
    assert transactions.read_manifest(path)["version"] == 1 and transactions.orphans(path) == []
    assert transactions.read_parts(spark, path, "a long").count() == 10


def test_repeated_attempts_and_rival_writers(tmp_path):
    path = str(tmp_path / "out")
    writer = transactions.PartWriter({"path": path}, SCHEMA, False)
    lost = writer.write_attempt(iter([batch((1, "x"))]), 0, 1)
    again = writer.write_attempt(iter([batch((1, "x")), batch((2, None))]), 0, 2)
    other = writer.write_attempt(iter([batch((3, "z"))]), 1, 3)
    nothing = writer.write_attempt(iter([]), 2, 4)
    rival = transactions.PartWriter({"path": path}, SCHEMA, False)
    late = rival.write_attempt(iter([batch((9, "q"))]), 0, 1)
    assert lost.name != again.name and transactions.read_manifest(path)["version"] == 0
    # messages come in any order; Spark hands over one for each partition
    writer.commit([other, None, again, nothing])
    assert [(p["rows"]) for p in transactions.read_manifest(path)["parts"]] == [2, 1]
    with pytest.raises(RuntimeError, match="another writer"):
        rival.commit([late])
    # a writer that died before its commit
    transactions.PartWriter({"path": path}, SCHEMA, False).write_attempt(iter([batch((5, "w"))]), 0, 1)
    assert len(transactions.orphans(path)) == 1
    assert len(transactions.clean_orphans(path)) == 1 and transactions.orphans(path) == []
    assert sum(p["rows"] for p in transactions.read_manifest(path)["parts"]) == 3
