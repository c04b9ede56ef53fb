"""Graph operators: degrees, breadth-first search, PageRank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weft.functions.exprs import fold_node, owner_block
from weft.operators.combine import Combiner, combine
from weft.operators.multibfs import bfs_masks, bfs_regions, find_hubs
from weft.session import joined_by_part_of_keys, materialize, materialize_by, parallelism, ship

#: A frontier of at most so many nodes is broadcast; a larger one is shuffled.
BROADCAST_NODES = 100_000
#: Edges of a graph that may be sent to all tasks: 12 bytes each.
REPLICATED_EDGES = 20_000_000


def out_degree(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """(node, degree): distinct targets of each source, or all of its edges."""
    count = F.countDistinct("dst") if distinct else F.count("dst")
    return edges.groupBy(F.col("src").alias("node")).agg(count.cast("long").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): each source's distinct targets in order."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def id_range(edges: DataFrame) -> DataFrame:
    """(low, high): least and greatest node id of either end."""
    return edges.agg(F.min(F.least("src", "dst")).alias("low"), F.max(F.greatest("src", "dst")).alias("high"))


def pick_sources(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(trial, node): n sources with an outgoing edge, in order of a hash; fails if the graph has no edge."""
    nodes = edges.select(F.col("src").alias("node")).distinct()
    rows = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(n).collect()
    if not rows:
        raise ValueError("the graph has no edges")
    return edges.sparkSession.createDataFrame([(i, r["node"]) for i, r in enumerate(rows)], "trial long, node long")


def bfs(edges: DataFrame, sources: DataFrame, strategy: str = "shuffle", max_levels: int | None = None) -> DataFrame:
    """(trial, node, dist): hops from each trial's source to every node that it reaches along the edges' direction.

    Strategies differ in the exchange alone:
    "shuffle" and "halves": edges and visited nodes lie bucketed by node id, "halves" with the ids' upper and lower half in
    buckets of their own; in each level the nodes reached are the one thing that moves.
    "broadcast": a frontier of at most BROADCAST_NODES rows is sent to all tasks, a larger one moves to the edges.
    "block": as shuffle, with edges dealt by runs of node ids.
    "scatter_reduce": every task gathers what its edges reach into sets of trials and nodes, which are merged where the
    nodes belong.
    "replicate": a graph of at most REPLICATED_EDGES edges goes to all tasks, which take trials whole; a larger one is
    shuffled.
    "masks": a row for each node with a bit for each of 64 trials, and hubs' edges in parts; many levels go on by regions.
    "regions": a task searches a run of node ids to the end, and what crosses into another moves; for graphs of many levels.
    Levels are written to the shared folder, so a lost executor costs at most the level in hand.
    """
    if strategy in ("masks", "regions"):
        return (bfs_masks if strategy == "masks" else bfs_regions)(edges, sources, max_levels)
    if strategy not in ("shuffle", "broadcast", "block", "halves", "scatter_reduce", "replicate"):
        raise ValueError(f"unknown strategy {strategy}")
    spark = edges.sparkSession
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    start = sources.select("trial", "node").where("trial is not null and node is not null").distinct()
    if strategy == "replicate":
        links = materialize(links)
        if links.limit(REPLICATED_EDGES + 1).count() <= REPLICATED_EDGES:
            return _bfs_replicated(links, start, max_levels)
    # with owners of nodes other than their hash, the owner takes the node's place as a key
    owner = None
    if strategy in ("block", "halves"):
        parts = parallelism(spark) if strategy == "block" else 2
        top = links.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
        half = parallelism(spark) // 2 or 1

        def owner(node: Column) -> Column:
            own = owner_block(node, (top or 0) + 1, parts)
            return own if strategy == "block" else own * half + F.pmod(node, F.lit(half))

    def place(node: str) -> Column:
        return F.col(node) if owner is None else owner(F.col(node))

    links, _ = materialize_by(links.select(place("src").alias("at"), "src", "dst"), "at")
    fresh = start.select(place("node").alias("at"), "trial", "node", F.lit(0).alias("dist"))
    seen, name = materialize_by(fresh, "at", partition_by="dist")
    level = 0
    while max_levels is None or level < max_levels:
        frontier = seen.where(F.col("dist") == level).select("at", "trial", "node")
        level += 1
        if strategy == "broadcast" and frontier.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
            frontier = F.broadcast(frontier)
        with joined_by_part_of_keys(spark):
            fresh = _next_level(links, frontier, seen, owner, strategy == "scatter_reduce").withColumn("dist", F.lit(level))
            seen, name = materialize_by(fresh, "at", into=name, partition_by="dist", dealt=True)
        if seen.where(F.col("dist") == level).isEmpty():
            break
    return seen.select("trial", "node", "dist")


def _next_level(links: DataFrame, frontier: DataFrame, seen: DataFrame, owner: Callable[[Column], Column] | None, sets: bool = False) -> DataFrame:
    """(at, trial, node) of the nodes that the frontier reaches first. What is reached moves to its owner's place; edges,
    frontier and visited nodes stay."""
    both = links.alias("e").join(frontier.alias("f"), (F.col("e.at") == F.col("f.at")) & (F.col("e.src") == F.col("f.node")))
    reached = both.select((F.col("dst") if owner is None else owner(F.col("dst"))).alias("at"), F.col("dst").alias("node"), "trial")
    if owner is not None:
        reached = reached.repartition(parallelism(links.sparkSession), "at").distinct()
    elif sets:
        # one set of nodes for each place and trial, merged where they belong
        reached = reached.groupBy("at").agg(F.collect_set(F.struct("trial", "node")).alias("found")).select("at", F.explode("found").alias("x")).select("at", "x.trial", "x.node")
    else:
        # all trials that reach a node meet there, in one exchange
        reached = reached.groupBy("at").agg(F.collect_set("trial").alias("trials")).select("at", F.col("at").alias("node"), F.explode("trials").alias("trial"))
    known = seen.select(F.col("at").alias("at_"), F.col("trial").alias("trial_"), F.col("node").alias("node_"))
    fresh = reached.join(known, (F.col("at") == F.col("at_")) & (F.col("node") == F.col("node_")) & (F.col("trial") == F.col("trial_")), "left_anti")
    return fresh.select("at", "trial", "node")


def _bfs_replicated(links: DataFrame, sources: DataFrame, max_levels: int | None) -> DataFrame:
    """BFS of each trial in one task over the whole graph, which all tasks get as sorted arrays."""
    spark = links.sparkSession
    rows = links.orderBy("src", "dst").toArrow()
    src, dst = (rows[c].to_numpy() for c in ("src", "dst"))
    nodes, begins = np.unique(src, return_index=True)
    ids = np.unique(np.concatenate([nodes, dst]))
    offsets = np.zeros(len(ids) + 1, np.int64)
    offsets[np.searchsorted(ids, nodes) + 1] = np.diff(np.append(begins, len(src)))
    shared = spark.sparkContext.broadcast((ids, np.cumsum(offsets), np.searchsorted(ids, dst).astype(np.int32)))

    def run(frames):
        ids, offsets, targets = shared.value
        for frame in frames:
            for trial, node in zip(frame["trial"], frame["node"]):
                dist = np.full(len(ids), -1, np.int32)
                at = int(np.searchsorted(ids, node))
                if at == len(ids) or ids[at] != node:
                    # a source without edges reaches itself
                    yield pd.DataFrame({"trial": [trial], "node": [node], "dist": np.zeros(1, np.int32)})
                    continue
                front, level = np.array([at]), 0
                dist[front] = 0
                while len(front) and (max_levels is None or level < max_levels):
                    level += 1
                    n = offsets[front + 1] - offsets[front]
                    to = targets[np.repeat(offsets[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    to = to[dist[to] < 0]
                    dist[to] = level
                    front = np.unique(to)
                found = np.flatnonzero(dist >= 0)
                for a in range(0, len(found), 1 << 18):
                    part = found[a : a + (1 << 18)]
                    yield pd.DataFrame({"trial": np.full(len(part), trial), "node": ids[part], "dist": dist[part]})

    ship()
    return sources.repartition(parallelism(spark), "trial", "node").mapInPandas(run, "trial bigint, node bigint, dist int")


def level_sizes(distances: DataFrame) -> DataFrame:
    """(trial, dist, n): nodes at each distance."""
    return distances.groupBy("trial", "dist").agg(F.count(F.lit(1)).alias("n"))


def compare_distances(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(n_found, n_expected, n_wrong): wrong are nodes whose distances differ or that only one side reaches."""
    a = found.select("trial", "node", F.col("dist").alias("a"))
    b = expected.select("trial", "node", F.col("dist").alias("b"))
    both = a.join(b, ["trial", "node"], "full_outer")
    return both.agg(F.count("a").alias("n_found"), F.count("b").alias("n_expected"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("n_wrong"))


def split_hubs(links: DataFrame, least: int | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(light, heavy, hubs): edges of all other nodes, edges of hubs dealt evenly over the partitions, and the hubs (node).
    Hubs have more than a quarter of a partition's share of the edges, and of `least`; without any, heavy and hubs are None."""
    hubs = materialize(find_hubs(links, least).select("node"))
    if hubs.isEmpty():
        return links, None, None
    of_hub = F.broadcast(hubs)
    heavy = links.join(of_hub, links.src == hubs.node, "left_semi").repartition(parallelism(links.sparkSession))
    return links.join(of_hub, links.src == hubs.node, "left_anti"), materialize(heavy), hubs


def shares(links: DataFrame, ranks: DataFrame) -> DataFrame:
    """(dst, got): what each edge (src, dst, deg) gives to its target of its node's rank."""
    return links.join(ranks, links.src == ranks.node).select("dst", (F.col("rank") / F.col("deg")).alias("got"))


def pagerank(edges: DataFrame, n_nodes: int, iterations: int | None = None, error: float = 5e-5, most: int = 30, combiner: Combiner | None = None, hub_edges: int | None = None) -> tuple[DataFrame, list[float]]:
    """((node, rank), errors): power iteration without damping over distinct edges, and each step's L2 change.

    All n_nodes nodes start with 1 / n_nodes; a node's rank goes in equal parts to its distinct targets, and what
    nodes without any hold is lost. Targets beyond the nodes wrap around. Stops after `iterations`, or without it once the
    change is below `error`, and after `most` steps at the latest. With a combiner (of states dst, got) that puts together
    what nodes are given, instead of a sum. Edges of hubs (see `split_hubs`) don't lie with their node: they stay in parts of
    even size, to which the hubs' ranks are sent. What is given to one node is added up in each task before it moves.
    """
    spark = edges.sparkSession
    if n_nodes <= 0:
        raise ValueError("a graph needs nodes")
    links = edges.select("src", "dst").distinct()
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    weighted = materialize(links.join(degree, "src").select("src", fold_node(F.col("dst"), n_nodes).alias("dst"), "deg"))
    # edges and ranks lie bucketed by node: in each step only what nodes are given moves
    light, heavy, hubs = split_hubs(weighted, hub_edges)
    links, _ = materialize_by(light, "src")
    ranks, _ = materialize_by(spark.range(n_nodes).select(F.col("id").alias("node"), F.lit(1.0 / n_nodes).alias("rank")), "node")
    errors: list[float] = []
    while len(errors) < (iterations if iterations is not None else most):
        parts = shares(links, ranks)
        if heavy is not None:
            # at most four hubs for each partition
            parts = parts.union(shares(heavy, F.broadcast(ranks.join(F.broadcast(hubs), "node", "left_semi"))))
        given = combine(parts, ["dst"], combiner) if combiner else parts.groupBy("dst").agg(F.sum("got").alias("got"))
        step = ranks.join(given, ranks.node == given.dst, "left").select("node", F.col("rank").alias("old"), F.coalesce("got", F.lit(0.0)).alias("rank"))
        change = Observation()
        step = step.observe(change, F.sum(F.pow(F.col("rank") - F.col("old"), 2)).alias("e"))
        ranks, _ = materialize_by(step.select("node", "rank"), "node")
        errors.append(float(change.get["e"]) ** 0.5)
        if iterations is None and errors[-1] < error:
            break
    return ranks, errors


def pagerank_trace(spark: SparkSession, errors: list[float]) -> DataFrame:
    """(iteration, error)."""
    return spark.createDataFrame(list(enumerate(errors, 1)), "iteration int, error double")
