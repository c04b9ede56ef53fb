import json
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import graph
from weft.operators.combine import sums
from weft.operators.components import connected_components
from weft.session import joined_by_part_of_keys, materialize_by
from weft.sources import csr, tables

#: The small graph of the golden values.
EDGES = [(0, 1), (0, 3), (1, 2), (1, 4), (2, 3), (3, 4), (4, 0), (4, 1), (4, 2)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def sources(spark, *nodes):
    return spark.createDataFrame(list(enumerate(nodes)), "trial long, node long")


def test_golden_distances_by_every_strategy(spark):
    expected = {(0, n, d) for n, d in {0: 0, 1: 1, 3: 1, 2: 2, 4: 2}.items()} | {(1, n, d) for n, d in {2: 0, 3: 1, 4: 2, 0: 3, 1: 3}.items()}
    results = []
    for strategy in ("shuffle", "broadcast", "block", "halves", "scatter_reduce", "replicate"):
        found = graph.bfs(frame(spark, EDGES + EDGES[:2]), sources(spark, 0, 2), strategy)
        assert {tuple(r) for r in found.select("trial", "node", "dist").collect()} == expected
        results.append(found)
    assert graph.compare_distances(*results[:2]).first().asDict() == {"n_found": 10, "n_expected": 10, "n_wrong": 0}
    with pytest.raises(ValueError):
        graph.bfs(frame(spark, EDGES), sources(spark, 0), "telepathy")


def test_grid_distances(spark):
    edges = tables.grid_edges(spark, 6, 5)
    assert edges.count() == 2 * (6 * 4 + 5 * 5)
    found = graph.bfs(edges, sources(spark, 0)).collect()
    assert {r["node"]: r["dist"] for r in found} == {r * 5 + c: r + c for r in range(6) for c in range(5)}


def test_golden_pagerank(spark):
    ranks, errors = graph.pagerank(frame(spark, EDGES + EDGES), 5)
    assert len(errors) == 24
    assert errors[0] == pytest.approx(0.2) and errors[1] == pytest.approx(0.1394433378) and errors[-1] == pytest.approx(3.298461959930939e-05)
    found = [r["rank"] for r in sorted(ranks.collect(), key=lambda r: r["node"])]
    assert found == pytest.approx([0.1052610026, 0.1578992833, 0.1842108510, 0.2368533894, 0.3157754737])
    ranks, errors = graph.pagerank(frame(spark, [(0, 1)]), 3, iterations=1)
    assert sorted(r["rank"] for r in ranks.collect()) == pytest.approx([0, 0, 1 / 3])


def test_pagerank_with_hubs_in_parts(spark):
    rng = random.Random(8)
    edges = [(3, i) for i in range(150)] + [(4, i) for i in range(0, 150, 2)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(400)]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
    rank = [1 / 150] * 150
    for _ in range(3):
        given = [0.0] * 150
        for a, to in links.items():
            for b in to:
                given[b] += rank[a] / len(to)
        rank = given
    light, heavy, hubs = graph.split_hubs(frame(spark, edges).distinct(), 20)
    assert {r["node"] for r in hubs.collect()} == {3, 4}
    assert light.count() + heavy.count() == sum(map(len, links.values())) and {r["src"] for r in heavy.collect()} == {3, 4}
    # a hub's edges lie in all parts alike
    sizes = [r["count"] for r in heavy.groupBy(F.spark_partition_id()).count().collect()]
    assert len(heavy.inputFiles()) == 4 and sum(sizes) == len(links[3]) + len(links[4])
    for options in ({"hub_edges": 20}, {"hub_edges": 20, "combiner": sums(["dst"])}, {}):
        found = graph.pagerank(frame(spark, edges), 150, iterations=3, **options)[0].collect()
        assert [r["rank"] for r in sorted(found, key=lambda r: r["node"])] == pytest.approx(rank)


def test_sources_and_degrees(spark):
    df = frame(spark, EDGES + [(0, 1)])
    assert {r["node"]: r["degree"] for r in graph.out_degree(df).collect()} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 3}
    assert {r["node"]: r["degree"] for r in graph.out_degree(df, distinct=False).collect()}[0] == 3
    assert graph.pick_sources(df, 2).count() == 2
    with pytest.raises(ValueError):
        graph.pick_sources(frame(spark, []), 1)
    assert graph.adjacency(df).where("node = 4").first()["neighbours"] == [0, 1, 2]


def test_edge_files(spark, tmp_path):
    text = tmp_path / "g.el"
    text.write_text("# c\n% c\n\n0 1\n 1\t2 9\nx 3\n4\n2 0\n2 0\n")
    edges = [(0, 1), (1, 2), (2, 0), (2, 0)]
    assert sorted(map(tuple, tables.read_graph(spark, str(text)).collect())) == edges
    assert sorted(map(tuple, tables.read_graph(spark, str(text), 1, 2).collect())) == [(1, 2)]
    assert tables.node_count(tables.read_graph(spark, str(text))).first()["n_nodes"] == 3
    binary = str(tmp_path / "g.sg")
    csr.write_csr(binary, edges + [(7, 5)])
    assert [tuple(r) for r in csr.read_csr(spark, binary, partitions=3).collect()] == edges + [(7, 5)]
    assert [tuple(r) for r in csr.read_csr(spark, binary, 2, 5).collect()] == [(2, 0), (2, 0)]
    assert tables.read_graph(spark, binary, 1, 8).count() == 4
    csr.write_csr(binary, [])
    assert csr.read_csr(spark, binary).count() == 0
    for i, part in enumerate([EDGES[:5], EDGES[5:] + EDGES[:1]]):
        (tmp_path / f"part-{i}.tsv").write_text("".join(f"{a}\t{b}\n" for a, b in part))
    assert tables.read_edge_tsv(spark, str(tmp_path / "part-*.tsv")).count() == 9


def test_graph_file_of_a_table(spark, tmp_path):
    rng = random.Random(9)
    edges = [(5, i) for i in range(300)] + [(rng.randrange(900), rng.randrange(1000)) for _ in range(3000)] + [(70_000, 3), (70_001, 80_000), (5, 7)]
    odd = edges + [(None, 1), (2, None)]
    for n, parts in ((1, edges), (7, odd), (7, [(2, 2)]), (3, [])):
        a, b = str(tmp_path / "a.sg"), str(tmp_path / "b.sg")
        csr.write_csr(a, sorted(x for x in parts if None not in x), directed=False)
        csr.write_csr_frame(frame(spark, parts).repartition(5), b, directed=False, partitions=n)
        with open(a, "rb") as x, open(b, "rb") as y:
            assert x.read() == y.read(), n
    csr.write_csr_frame(frame(spark, edges), b)
    assert [tuple(r) for r in csr.read_csr(spark, b).collect()] == sorted(edges)


def test_result_files(spark, tmp_path):
    path = tmp_path / "out.json"
    path.write_text(json.dumps([{"worker_id": 1, "timestamps": [], "local_distances": [[0, 0], [3, 1]]}]))
    assert [tuple(r) for r in tables.read_results(spark, str(path)).collect()] == [(1, 0, 0), (1, 3, 1)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(35)] + [(9, 9), (200, 200), (None, 3), (500, 40)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in up}


def test_edges_and_ranks_stay_where_they_are(spark):
    rng = random.Random(4)
    edges = frame(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(2000)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links, name = materialize_by(edges, "src")
        ranks, _ = materialize_by(spark.range(300).withColumnRenamed("id", "node"), "node")
        joined = links.join(ranks, links.src == ranks.node)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        step = joined.groupBy("dst").count()
        plan = ranks.join(step, ranks.node == step.dst, "left")._jdf.queryExecution().executedPlan().toString()
        # what nodes are given moves, nothing else
        assert plan.count("Exchange hashpartitioning(dst") == 1 and plan.count("Exchange ") == 1
        # in a level of a search the nodes reached move, and neither edges nor frontier nor visited nodes do
        at = edges.select(F.col("src").alias("at"), "src", "dst")
        around, _ = materialize_by(at, "at")
        seen, _ = materialize_by(spark.range(20).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("trial"), F.col("id").alias("node"), F.lit(0).alias("dist")), "at", partition_by="dist")
        frontier = seen.where("dist = 0").select("at", "trial", "node")
        with joined_by_part_of_keys(spark):
            for sets in (False, True):
                plan = graph._next_level(around, frontier, seen, None, sets)._jdf.queryExecution().executedPlan().toString()
                assert plan.count("Exchange ") == 1, plan
        more, _ = materialize_by(edges.limit(5), "src", into=name)
        assert more.count() == links.count() + 5 or more.count() == 2005
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_strategies_agree_on_a_random_graph(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(None, 1), (2, None), (70, 71)]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
    expected = set()
    for trial, source in enumerate((0, 3, 71, 999)):
        dist, front = {source: 0}, [source]
        while front:
            front = [b for a in front for b in links.get(a, ()) if b is not None and b not in dist and not dist.update({b: dist[a] + 1})]
        expected |= {(trial, n, d) for n, d in dist.items()}
    for strategy in ("shuffle", "broadcast", "block", "halves", "scatter_reduce", "replicate"):
        found = graph.bfs(frame(spark, edges), sources(spark, 0, 3, 71, 999), strategy)
        assert {tuple(r) for r in found.select("trial", "node", "dist").collect()} == expected, strategy
    capped = graph.bfs(frame(spark, edges), sources(spark, 0), "replicate", max_levels=1).collect()
    assert {(r["trial"], r["node"], r["dist"]) for r in capped} == {x for x in expected if x[0] == 0 and x[2] <= 1}
