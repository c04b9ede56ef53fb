import random

from pyspark.sql import functions as F

from weft.functions.exprs import range_bucket
from weft.operators import sort
from weft.sources import sinks, tables


def frame(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "n long, k string")


def test_bucket_of_a_key(spark):
    for bounds, expected in [(["c", "f", "k"], dict(a=0, c=0, d=1, f=1, g=2, k=2, z=3)), (["c", "f", "f", "k"], dict(d=1, f=1, g=3, k=3, z=4))]:
        rows = frame(spark, [*expected, None]).withColumn("b", range_bucket(F.col("k"), F.array(*map(F.lit, bounds)))).collect()
        assert {r["k"]: r["b"] for r in rows} == expected | {None: len(bounds)}


def test_bounds_are_exact_quantiles(spark):
    rng = random.Random(1)
    for keys in ([rng.choice("abcdefgh") * rng.randint(0, 9) for _ in range(500)], ["same"] * 50, ["x"], [None, "é", "e", "z" * 20]):
        known = sorted((k for k in keys if k is not None), key=lambda k: k.encode())
        found = sort.quantile_bounds(frame(spark, keys), F.col("k"), 5).first()["bounds"]
        assert found == [known[int(i / 5 * len(known))] for i in range(1, 5)]
    assert sort.quantile_bounds(frame(spark, []), F.col("k"), 5).first()["bounds"] == []
    assert sort.quantile_bounds(frame(spark, ["a"]), F.col("k"), 1).first()["bounds"] == []


def test_ranks_of_both_sorts_and_their_check(spark):
    rng = random.Random(2)
    keys = [rng.choice([None, "a", "b", "cc", "d", "é"]) for _ in range(300)]
    df = frame(spark, keys)
    expected = sorted(range(300), key=lambda i: (keys[i] is None, (keys[i] or "").encode(), i))
    for ranked in (sort.global_rank(df, ["k", "n"], 4), sort.staged_sort(df, F.col("k"), ["k", "n"], 4)):
        rows = sorted(ranked.collect(), key=lambda r: r["rank"])
        assert [r["n"] for r in rows] == expected and [r["rank"] for r in rows] == list(range(1, 301))
        assert sort.validate_sort(ranked, ["k"]).first().asDict() == {"n": 300, "distinct_ranks": 300, "inversions": 0}
    wrong = frame(spark, ["b", "a", "c"]).withColumnRenamed("n", "rank")
    assert sort.validate_sort(wrong, ["k"]).first()["inversions"] == 1
    rows = sort.sort_exchange(df, ["k", "n"], 3).collect()
    assert [r["n"] for r in rows] == expected


def test_sorted_files_and_table_reader(spark, tmp_path):
    keys = ["pear", "apple", 'q"uote', "fig", "apple"]
    path = str(tmp_path / "out")
    sinks.write_sorted_csv(frame(spark, keys), "k", path, 3, "n")
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert [line.split(",")[1] for line in lines] == sorted(keys)
    back = tables.read_sort_table(spark, path, 2)
    assert sorted(r["c1"] for r in back.collect()) == sorted(keys)
    assert sort.uniform_lengths(frame(spark, ["aa", "bb"]), F.col("k")).first()["uniform"]
    staged = str(tmp_path / "staged")
    sinks.stage_buckets(frame(spark, keys).withColumn("b", F.col("n") % 2), "b", staged)
    assert spark.read.parquet(staged).count() == 5
    sinks.write_results(frame(spark, keys), str(tmp_path / "json"))
    sinks.write_stats(frame(spark, keys), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["n", "k"]


def test_ranges(spark):
    rows = tables.row_ranges(spark, 1003, 4, 10).collect()
    assert [(r["start"], r["stop"]) for r in rows] == [(0, 260), (260, 520), (520, 780), (780, 1003)]
    rows = tables.group_ranges(spark, 1003, 8, 4).collect()
    for group in (rows[:4], rows[4:]):
        assert [(r["start"], r["stop"]) for r in group] == [(0, 250), (251, 500), (501, 750), (751, 1003)]
    assert rows[5]["base"] == 4
    assert 0 < tables.sample_rows(frame(spark, [str(i) for i in range(1000)]), "k", 10).count() < 300
