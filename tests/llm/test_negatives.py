import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int, score double, cell string, v int"


def brute(rows, every=100, positives=5, most=5, low=80, high=100):
    """Rows of the contract, by scores of all pairs."""
    fine = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, lab, v in fine:
        if i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in fine if len(w) == len(v)]
        for p, j in sorted((s, j) for s, j, other in scores if other == lab and j != i)[:positives]:
            fit = sorted((s, j) for s, j, other in scores if other != lab and low * -p <= 100 * -s <= high * -p)
            out += [(i, j, n + 1, m, -p, -s) for n, (s, m) in enumerate(fit[:most])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1.0, "x", 7) for i, v, lab in rows], ROWS)


def found(spark, rows, every=100, **more):
    out = negatives.hard_negatives(frame(spark, rows), F.col("id") % every == 0, "vec_id", F.col("label"), "embedding", **more)
    return sorted(map(tuple, out.collect()))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 40)
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(negatives, "SAMPLE", 120)


def vectors(n, dims, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(clusters, size=n)] + 0.4 * rng.normal(size=(n, dims))
    return [[float(c) for c in r] for r in 0.5 * x]


@pytest.mark.parametrize("clusters", [1, 6])
def test_equals_all_pairs(spark, small, clusters):
    rng = random.Random(5)
    rows = [(i, v, rng.randrange(4)) for i, v in enumerate(vectors(500, 6, clusters, 3))]
    assert found(spark, rows, 20) == brute(rows, 20)
    assert found(spark, rows, 50, positives=3, negatives=7, low=50, high=90) == brute(rows, 50, 3, 7, 50, 90)


def test_odd_rows(spark, small):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(240)]
    rows += [(300 + i, [0.5, 0.5, 0.25], i % 3) for i in range(200)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (600, None, 1), (601, [1.0, None, 0.0], 1), (602, [float("nan"), 0.0, 0.0], 2), (603, [float("inf"), 0.0, 0.0], 2), (604, [1.0, 1.0, 1.0], None)]
    rows += [(700, [0.0, 0.0, 0.0], 0), (800, [-1.0, -1.0], 0), (801, [-1.0, -0.9], 0), (802, [-1.0, -0.8], 1), (900, [], 0), (901, [], 0), (902, [], 1)]
    rows += rows[:30] + [(0, [0.25, 0.25, 0.5], 2)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 0.0], 1)]) == []
    assert found(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2)]) == [(0, 1, 1, 2, 65536, 58880)]
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(0, [1e9], 1), (1, [1.0], 1)])


def test_tree_bounds_hold():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(300, 5)))
    tree = negatives.VantageTree(x, float((x**2).sum(axis=1).max()), leaf=10)
    anchors = np.floor(256 * rng.normal(size=(7, 5)))
    least, greatest = negatives.node_bounds(tree, anchors)

    def below(n):
        kids = tree.kids[n]
        return np.concatenate([below(k) for k in kids]) if kids else tree.rows[n]

    assert sorted(below(0)) == list(range(300))
    for n in range(len(tree.rows)):
        scores = x[below(n)] @ anchors.T
        assert (scores.min(axis=0) >= least[n]).all() and (scores.max(axis=0) <= greatest[n]).all()
    # with bounds like these a search near the anchor leaves parts of the tree alone
    assert (greatest.min(axis=0) < (x @ anchors.T).max(axis=0)).sum() >= 5


def test_copies_are_folded_and_cells_split(spark, small):
    rows = [(i, [0.5, 0.25, 0.125], 1) for i in range(900)] + [(1000 + i, v, i % 3) for i, v in enumerate(vectors(300, 3, 4, 2))]
    every = negatives.usable(frame(spark, rows), "vec_id", F.col("label"), "embedding")
    kept = negatives.first_of_copies(every, 6)
    assert sorted(r["id"] for r in kept.where("id < 1000").collect()) == list(range(6))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    dealt, cells, _ = negatives.deal(kept)
    sizes = [r["count"] for r in dealt.groupBy("size", "cell", "salt").count().collect()]
    assert sum(sizes) == 306 and max(sizes) < 80 and len(sizes) >= 306 // 40
