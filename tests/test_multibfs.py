import random
import tracemalloc
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import graph, multibfs
from weft.sources import tables


def brute(edges, sources, most=None):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = set()
    for trial in {t for t, _ in sources}:
        dist = {v: 0 for t, v in sources if t == trial}
        queue = deque(dist)
        while queue:
            u = queue.popleft()
            if most is None or dist[u] < most:
                for v in ahead.get(u, ()):
                    if v not in dist:
                        dist[v] = dist[u] + 1
                        queue.append(v)
        out |= {(trial, v, d) for v, d in dist.items()}
    return out


def frames(spark, edges, sources):
    return spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(sources, "trial long, node long")


@pytest.fixture(scope="module")
def random_graph():
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(380)]
    hub = [(7, i) for i in range(0, 200, 2)]
    return edges + hub, [(i, rng.randrange(210)) for i in range(70)] + [(3, 7), (-1, 7), (3, 7)]


def test_random_graph_with_a_hub(spark, random_graph):
    edges, sources = random_graph
    want = brute(edges, sources)
    e, s = frames(spark, edges + edges[:9], sources)
    odd = e.union(spark.createDataFrame([(None, 3), (4, None)], "src long, dst long"))
    assert {tuple(r) for r in multibfs.bfs_masks(odd, s, deep=None, hub_edges=40).collect()} == want
    # a few levels by masks, the rest by regions
    assert {tuple(r) for r in multibfs.bfs_masks(e, s, deep=2, hub_edges=40).collect()} == want
    rows = multibfs.bfs_regions(odd, s, regions=5, hub_edges=40).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_levels_are_limited(spark, random_graph, monkeypatch):
    edges, sources = random_graph
    monkeypatch.setattr(multibfs, "GATHER", 2)
    monkeypatch.setattr(multibfs, "BROADCAST_ROWS", 3)
    e, s = frames(spark, edges, sources)
    assert {tuple(r) for r in multibfs.bfs_masks(e, s, 4, hub_edges=40).collect()} == brute(edges, sources, 4)
    assert {tuple(r) for r in multibfs.bfs_regions(e, s, 3, regions=4).collect()} == brute(edges, sources, 3)


def test_a_region_follows_bounded_numbers_of_edges(monkeypatch):
    # 400 nodes on each side, all joined: 400 x 64 places follow 400 edges each in the second level
    side, trials = 400, 64
    a, b = (x.ravel() for x in np.meshgrid(np.arange(side), np.arange(side) + side))
    edges = np.concatenate([a, b]), np.concatenate([b, a])
    dists = np.full((2 * side, trials), multibfs.FAR, np.int32)
    starts = np.arange(trials) * trials + np.arange(trials)
    dists.reshape(-1)[starts] = 0
    monkeypatch.setattr(multibfs, "FOLLOWED", 100_000, raising=False)
    tracemalloc.start()
    found = multibfs.search_region(edges, np.arange(2 * side), dists, starts, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.full((2 * side, trials), 1)
    want[:side] = 2
    want[np.arange(trials), np.arange(trials)] = 0
    assert (found == want).all()
    # the edges take 8 MB and are sorted; following all pairs at once took over 200 MB
    assert peak < 40e6


def test_fewer_trials_at_once_in_large_regions(spark, random_graph, monkeypatch):
    edges, sources = random_graph
    monkeypatch.setattr(multibfs, "REGION_PLACES", 2_000)
    searches = []
    search = multibfs._search
    monkeypatch.setattr(multibfs, "_search", lambda placed, work, *a: searches.append(work.selectExpr("max(size(dists))").first()[0]) or search(placed, work, *a))
    e, s = frames(spark, edges, sources)
    assert {tuple(r) for r in multibfs.bfs_regions(e, s, regions=4, hub_edges=40).collect()} == brute(edges, sources)
    # 470 edges or fewer in four regions: at least 17 trials at once, and 71 trials take several searches
    assert len(searches) > 2 and max(searches) <= 2_000 // (len(set(edges)) // 4)


@pytest.mark.parametrize("strategy", ["masks", "regions"])
def test_deep_grid_and_small_cases(spark, strategy):
    found = graph.bfs(tables.grid_edges(spark, 40, 25), spark.createDataFrame([(0, 0), (1, 999)], "trial long, node long"), strategy)
    assert {tuple(r) for r in found.collect()} == {(0, r * 25 + c, r + c) for r in range(40) for c in range(25)} | {(1, r * 25 + c, 39 - r + 24 - c) for r in range(40) for c in range(25)}
    none = spark.createDataFrame([], "trial long, node long")
    assert graph.bfs(spark.createDataFrame([(0, 1)], "src long, dst long"), none, strategy).collect() == []
    empty = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in graph.bfs(empty, spark.createDataFrame([(5, 8)], "trial long, node long"), strategy).collect()] == [(5, 8, 0)]
    loop = spark.createDataFrame([(3, 3), (3, 4)], "src long, dst long")
    assert {tuple(r) for r in graph.bfs(loop, spark.createDataFrame([(63, 3), (64, 4)], "trial long, node long"), strategy).collect()} == {(63, 3, 0), (63, 4, 1), (64, 4, 0)}


def test_a_hub_lies_in_parts_and_one_exchange_moves_a_level(spark):
    edges = spark.range(4000).select(F.lit(0).cast("long").alias("src"), (F.col("id") + 1).alias("dst")).union(spark.range(400).select((F.col("id") + 1).alias("src"), F.lit(0).cast("long").alias("dst")))
    links = multibfs.clean_edges(edges)
    hubs = multibfs.find_hubs(links, 100)
    assert [r["node"] for r in hubs.collect()] == [0]
    # the share of a partition of four, by a quarter: 4400 / 16
    assert hubs.first()["splits"] == -(-4000 // 275)
    levels = multibfs._Levels(spark)
    dealt = links.join(F.broadcast(hubs), F.col("src") == F.col("node"), "left")
    dealt = levels.table(dealt.select(F.when(F.col("splits").isNull(), F.col("src")).otherwise(F.xxhash64("src", F.pmod(F.xxhash64("dst"), F.col("splits")))).alias("at"), "src", "dst"), "at")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2400 and len(sizes) == 4
    levels.add(spark.createDataFrame([(0, 0, 1)], "node long, grp long, mask long").repartition(4, "node", "grp"), 0)
    front = levels.since(0)
    fresh = multibfs.next_masks(dealt, front, front.select("node", "grp", "mask"), hubs, True)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    # edges and known masks stay where they are; partial OR comes before what is reached moves
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("partial_bit_or") >= 1
    assert fresh.count() == 4000
    levels.drop()


def test_symmetric_graphs_read_two_levels(spark, monkeypatch):
    read = []
    since = multibfs._Levels.since
    monkeypatch.setattr(multibfs._Levels, "since", lambda self, level: read.append(level) or since(self, level))
    grid = tables.grid_edges(spark, 3, 3)
    assert multibfs.is_symmetric(multibfs.clean_edges(grid))
    assert not multibfs.is_symmetric(grid.where("src < 8"))
    found = multibfs.bfs_masks(grid, spark.createDataFrame([(0, 0)], "trial long, node long"), deep=None)
    assert found.agg(F.max("dist")).first()[0] == 4
    assert read == [-1, 0, 0, 1, 1, 2, 2, 3, 3, 4]
    assert not [t for t in spark.catalog.listTables() if t.name in multibfs._Levels(spark).names]
