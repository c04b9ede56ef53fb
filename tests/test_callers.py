"""Functions of the caller's: combiners and actions; k-means that keeps its memberships."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import actions, combine, graph, kmeans


@pytest.mark.parametrize("held", [1 << 16, 10])
def test_sums_of_hot_and_null_keys(spark, monkeypatch, held):
    monkeypatch.setattr(combine, "HELD", held)
    monkeypatch.setattr(combine, "FAN_IN", 8)
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", f"k{rng.randrange(90)}"]), rng.randrange(3), rng.randrange(100), 0.5) for _ in range(4000)]
    df = spark.createDataFrame(rows, "k string, part int, n long, x double").repartition(30)
    found = combine.combine(df, ["k", "part"], combine.sums(["k", "part"])).collect()
    want, counts = Counter(), Counter()
    for k, part, n, _ in rows:
        want[k, part] += n
        counts[k, part] += 1
    assert len(found) == len(want)
    assert {(r["k"], r["part"]): (r["n"], r["x"]) for r in found} == {key: (n, counts[key] / 2) for key, n in want.items()}


def test_one_state_in_all_and_of_no_rows(spark, monkeypatch):
    monkeypatch.setattr(combine, "FAN_IN", 4)

    def widest(table):
        n = [max(table["high"].to_pylist())]
        low = [min(table["low"].to_pylist())]
        return combine.pa.table({"low": low, "high": n}, schema=table.schema)

    df = spark.range(0, 5000, 1, 20).select(F.col("id").alias("low"), (F.col("id") * 2).alias("high"))
    assert [tuple(r) for r in combine.combine(df, [], widest).collect()] == [(0, 9998)]
    assert combine.combine(df.where("low < 0"), [], widest).collect() == []
    assert combine.combine(df.where("low < 0"), ["low"], combine.sums(["low"])).collect() == []


def test_no_group_is_collected(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = combine.combine(df, ["k"], combine.sums(["k"]))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "collect" not in plan and plan.count("MapInArrow") == 2


def test_pagerank_by_a_combiner(spark):
    edges = spark.createDataFrame([(0, 1), (0, 3), (1, 2), (1, 4), (2, 3), (3, 4), (4, 0), (4, 1), (4, 2)], "src long, dst long")
    by_sum, errors = graph.pagerank(edges, 5, iterations=3)
    by_caller, other = graph.pagerank(edges, 5, iterations=3, combiner=combine.sums(["dst"]))
    a, b = ({r["node"]: r["rank"] for r in x.collect()} for x in (by_sum, by_caller))
    assert a == pytest.approx(b) and errors == pytest.approx(other)


def halves(n, label):
    if n == 4:
        raise KeyError("four")
    if n == 5:
        return None
    return ({"part": n / 2, "label": label} for _ in range(n % 3))


def late(n, label):
    yield {"part": 1.0}
    raise RuntimeError(f"after one of {n}")


def test_actions(spark):
    params = spark.createDataFrame([(n, f"l{n}") for n in range(8)], "n int, label string").repartition(3)
    known = {"halves": (halves, "part double, label string"), "late": (late, "part double"), "one": (lambda n, label: {"twice": 2 * n}, "twice long")}
    found = actions.run_action(params, known, "halves", "n").orderBy("call", "place")
    assert found.columns == ["call", "place", "part", "label", "error"]
    want = [(n, i, n / 2, f"l{n}", None) for n in range(8) if n not in (4, 5) for i in range(n % 3)] + [(4, 0, None, None, "KeyError: 'four'")]
    assert [tuple(r) for r in found.collect()] == sorted(want)
    # columns follow from the name
    assert [tuple(r) for r in actions.run_action(params.where("n = 3"), known, "one", "label").collect()] == [("l3", 0, 6, None)]
    assert sorted(map(tuple, actions.run_action(params.where("n = 3"), known, "late", "n").collect())) == [(3, 0, 1.0, None), (3, 1, None, "RuntimeError: after one of 3")]
    assert actions.run_action(params.where("n > 90"), known, "one", "n").collect() == []
    with pytest.raises(Exception, match="no action is called none"):
        actions.run_action(params, known, "none", "n").collect()


def points(spark, n=900, dims=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 4 * rng.normal(size=(7, dims))[rng.integers(7, size=n)]
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, f array<double>").repartition(3), x


def test_bounded_steps_are_lloyds(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK", 100)
    df, x = points(spark)
    odd = df.union(spark.createDataFrame([(-1, None), (-2, [1.0]), (-3, [1.0, None, 2.0, 3.0])], "id long, f array<double>"))
    first = kmeans.first_points(df, "id", "f", 7)
    found, trace = kmeans.bounded_fit(odd, first, "f", 6)
    assert np.allclose(found, kmeans.fit(df, first, "f", 6))
    # memberships of each step by distances to all centroids
    owners, c = [], first
    for _ in range(6):
        owners.append(((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1))
        c = np.array([x[owners[-1] == k].mean(axis=0) if (owners[-1] == k).any() else np.zeros(4) for k in range(7)])
    assert [t["moved"] for t in trace] == [900] + [int((a != b).sum()) for a, b in zip(owners, owners[1:])]
    assert all(t["n"] == 900 and t["delta"] == t["moved"] / 900 for t in trace)
    # 6,300 distances would be worked out in each step without bounds
    work = [t["distances"] for t in trace]
    assert work[0] == 6300 and work[-1] < work[0] / 3 and work == sorted(work, reverse=True)


def test_bounded_fit_stops_and_small_cases(spark):
    df, x = points(spark, 200, 2, 3)
    first = kmeans.first_points(df, "id", "f", 3)
    _, trace = kmeans.bounded_fit(df, first, "f", 50, delta=0.02)
    assert trace[-1]["delta"] <= 0.02 < trace[-2]["delta"] and len(trace) < 50
    alone, trace = kmeans.bounded_fit(df, first[:1], "f", 2)
    assert np.allclose(alone[0], x.mean(axis=0)) and [t["moved"] for t in trace] == [200, 0]
    far = np.vstack([first, [[1e6, 1e6]]])
    assert np.allclose(kmeans.bounded_fit(df, far, "f", 1)[0][3], 0)
    twice = np.vstack([first[:1], first[:1]])
    assert np.allclose(kmeans.bounded_fit(df, twice, "f", 1)[0], kmeans.fit(df, twice, "f", 1))
    none, trace = kmeans.bounded_fit(df.where("id < 0"), first, "f", 2)
    assert trace[0]["n"] == 0 and np.allclose(none, 0)
