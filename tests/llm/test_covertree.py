import numpy as np

from weft.llm import covertree
from weft.llm.covertree import CoverTree, Links, dual_traversal, embedding_links

SCHEMA = "vec_id long, embedding array<float>, label int"


def points(seed=1, n=300, d=8):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, d))
    near = base[rng.integers(0, 20, n // 3)] + rng.standard_normal((n // 3, d)) * 0.25
    tight = base[0] + rng.standard_normal((n // 3, d)) * 0.02
    return np.concatenate([base, near, tight]).astype(np.float32)


def brute(rows, cosine=0.9):
    ok = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            ok[i] = x / np.linalg.norm(x)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(rows)
    for i in ok:
        for j in ok:
            if j < i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine - 1e-12:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {rows[i][0]: (n[i], rows[root(i)][0]) for i in range(len(rows))}


def test_tree_covers_and_halves():
    x = points().astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for i in range(len(tree.lo)):
        d = covertree.gaps(tree.points[tree.centre[i]][None], tree.points[tree.lo[i] : tree.hi[i]])
        assert d.max() <= tree.radius[i] + 1e-7
        kids = range(tree.first[i], tree.last[i])
        assert not kids or (tree.lo[kids[0]] == tree.lo[i] and tree.hi[kids[-1]] == tree.hi[i])
        for k in kids:
            assert tree.radius[k] <= max(tree.radius[i], 2.0) / 2 + 1e-7


def test_traversal_of_one_and_two_trees():
    x = points(4).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cosine in (0.5, 0.9, 0.99):
        tree = CoverTree(x)
        links = Links(np.arange(len(x))[tree.order], np.ones(len(x), int))
        dual_traversal(tree, tree, links, 0, cosine)
        full = (x @ x.T >= cosine).sum(axis=1) - 1
        assert (links.n == full[tree.order]).all()
        a, b = CoverTree(x[:170]), CoverTree(x[170:])
        links = Links(np.concatenate([np.arange(170)[a.order], np.arange(170, len(x))[b.order]]), np.ones(len(x), int))
        dual_traversal(a, b, links, 170, cosine)
        cross = (x[:170] @ x[170:].T >= cosine)
        assert (links.n[:170] == cross.sum(axis=1)[a.order]).all() and (links.n[170:] == cross.sum(axis=0)[b.order]).all()


def check(spark, rows):
    found = embedding_links(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert {r["id"]: (r["n_links"], r["component"]) for r in found} == brute(rows)
    assert len(found) == len(rows)


def test_rows_against_brute_force(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(points(2))]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] + [1.0] * 7), (1004, [float("inf")] * 8), (1005, [None] + [1.0] * 7), (1006, [1.0, 2.0])]
    rows += [(2000 + i, rows[0][1]) for i in range(5)] + [(2100, [2 * x for x in rows[0][1]]), (2101, [1.0, 2.0]), (2102, [1e30] * 8), (2103, [1e-30] * 8)]
    check(spark, rows)
    monkeypatch.setattr(covertree, "BLOCK", 50)
    check(spark, rows)


def test_empty_and_useless_tables(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, None), (2, [0.0])])
    check(spark, [(7, [1.0, 1.0])])
