"""Breadth-first search from many sources at once: bit masks level by level, and whole regions of a graph in each step.

Masks are for graphs of few levels and any degrees: a node's row holds a bit for each of 64 trials, so that a level is one
join and one exchange for all of them. Regions are for graphs of many levels: a task searches its own part of the graph to
the end, and only what crosses into other parts moves, so there are as many steps as borders on the shortest paths.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weft.functions.exprs import range_bucket
from weft.session import materialize, parallelism, shared_dir, ship

#: Trials of a mask.
BITS = 64
#: Rows of a frontier that may be sent to all tasks; a larger one moves to the edges.
BROADCAST_ROWS = 100_000
#: Visited levels are gathered into one mask a node after so many.
GATHER = 8
#: Levels after which a search by masks goes on by regions.
DEEP = 12
#: Out-edges from which a node can be a hub, and edges of a region.
HUB_EDGES, REGION_EDGES = 100_000, 1_000_000
#: Edges of a region times trials that are searched at once, and pairs of an edge and a trial that are followed at once.
REGION_PLACES, FOLLOWED = 16_000_000, 1_000_000
#: The distance of nodes that aren't reached.
FAR = np.int32(2**31 - 1)


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null").distinct()


def find_hubs(links: DataFrame, least: int | None = None) -> DataFrame:
    """(node, splits): nodes with more than a quarter of a partition's share of the edges, and `least`, and in how many parts
    their edges are dealt. By that share there are at most four of them for each partition."""
    parts = parallelism(links.sparkSession)
    share = max(HUB_EDGES if least is None else least, links.count() // (4 * parts))
    degree = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
    return degree.select("node", F.ceil(F.col("n") / share).cast("long").alias("splits"))


def is_symmetric(links: DataFrame) -> bool:
    """Whether every edge between unlike nodes has one back; links are distinct."""
    pairs = links.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.where("n <> 2").isEmpty()


def bit_of(trial: Column) -> Column:
    """The mask with the trial's bit alone."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(trial, F.lit(BITS)).cast("int"))


def trials_of(masks: DataFrame) -> DataFrame:
    """(trial, node, dist) of rows of masks."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1).cast("long")) == 1)
    return masks.select("node", F.explode(bits).alias("b"), "grp", "dist").select((F.col("grp") * BITS + F.col("b")).alias("trial"), "node", "dist")


class _Levels:
    """Masks by level in a table bucketed by node and group of trials; groupings and joins by both leave them in place."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, parallelism(spark)
        self.names: list[str] = []
        self.name = self._name()

    def _name(self) -> str:
        self.names.append(f"weft_{uuid.uuid4().hex}")
        return self.names[-1]

    def _write(self, df: DataFrame, name: str, *by: str, partition_by: str | None = None) -> None:
        writer = df.write.mode("append").format("parquet").option("compression", "zstd").option("path", f"{shared_dir(self.spark)}/{name}").bucketBy(self.n, *by)
        (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(name)

    def table(self, df: DataFrame, *by: str) -> DataFrame:
        """df in a bucketed table of its own."""
        self._write(df.repartition(self.n, *by), name := self._name(), *by)
        return self.spark.table(name)

    def add(self, df: DataFrame, level: int) -> int:
        """Adds a level, whose rows lie by node and group; gives their number."""
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("dist", F.lit(level))
        self._write(df.select("node", "grp", "mask", "dist"), self.name, "node", "grp", partition_by="dist")
        return seen.get["n"]

    def since(self, level: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("dist") >= level)

    def close(self) -> DataFrame:
        """All levels, read by path; the catalog keeps no table, the shared folder keeps the files."""
        out = self.spark.read.schema("node long, grp long, mask long, dist int").parquet(f"{shared_dir(self.spark)}/{self.name}")
        self.drop()
        return out.select("node", "grp", "mask", "dist")

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def next_masks(links: DataFrame, frontier: DataFrame, known: DataFrame, hubs: DataFrame | None, small: bool) -> DataFrame:
    """(node, grp, mask): trials that reach a node first. What is reached moves once, to its node and group, and is joined by
    OR before and after; edges and known masks stay. Hubs' edges lie in parts, so their frontier rows are copied to each."""
    front = frontier.select(F.col("node").alias("f_src"), "grp", "mask")
    if small:
        both = links.join(F.broadcast(front), F.col("src") == F.col("f_src"))
    elif hubs is None:
        both = links.join(front, F.col("at") == F.col("f_src"))
    else:
        parts = front.join(F.broadcast(hubs), F.col("f_src") == hubs["node"], "left")
        parts = parts.select("f_src", "grp", "mask", F.explode(F.when(F.col("splits").isNull(), F.array("f_src")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1), lambda s: F.xxhash64("f_src", s)))).alias("f_at"))
        both = links.join(parts, (F.col("at") == F.col("f_at")) & (F.col("src") == F.col("f_src")))
    reached = both.groupBy(F.col("dst").alias("node"), "grp").agg(F.bit_or("mask").alias("mask"))
    old = known.groupBy("node", "grp").agg(F.bit_or("mask").alias("old")).select(F.col("node").alias("o_node"), F.col("grp").alias("o_grp"), "old")
    fresh = reached.join(old, (F.col("node") == F.col("o_node")) & (F.col("grp") == F.col("o_grp")), "left")
    mask = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
    return fresh.select("node", "grp", mask.alias("mask")).where("mask <> 0")


def bfs_masks(edges: DataFrame, sources: DataFrame, max_levels: int | None = None, symmetric: bool | None = None, deep: int | None = DEEP, hub_edges: int | None = None) -> DataFrame:
    """(trial, node, dist): hops from each trial's sources to every node that it reaches.

    A row holds a node's mask of 64 trials (others in rows of other groups) until the result is made. In a symmetric graph
    what a level reaches can only have been seen in the last two, so no others are read; else the masks of all are gathered
    every GATHER levels. After `deep` levels the rest is searched by regions, from the last frontier on.
    """
    spark = edges.sparkSession
    links = materialize(clean_edges(edges))
    both_ways = is_symmetric(links) if symmetric is None else symmetric
    hubs = materialize(find_hubs(links, hub_edges))
    hubs = None if hubs.isEmpty() else hubs
    levels = _Levels(spark)
    at = F.col("src") if hubs is None else F.when(F.col("splits").isNull(), F.col("src")).otherwise(F.xxhash64("src", F.pmod(F.xxhash64("dst"), F.col("splits"))))
    dealt = links if hubs is None else links.join(F.broadcast(hubs), F.col("src") == F.col("node"), "left")
    dealt = levels.table(dealt.select(at.alias("at"), "src", "dst"), "at")
    start = sources.select(F.col("trial").cast("long"), F.col("node").cast("long")).where("trial is not null and node is not null")
    start = start.groupBy("node", F.floor(F.col("trial") / BITS).cast("long").alias("grp")).agg(F.bit_or(bit_of(F.col("trial"))).alias("mask"))
    n = levels.add(start.repartition(levels.n, "node", "grp"), 0)
    gathered, upto, level = None, 0, 0
    while n and (max_levels is None or level < max_levels):
        if deep is not None and level == deep:
            return _go_on(links, levels.close(), level, max_levels)
        if both_ways:
            known = levels.since(level - 1).select("node", "grp", "mask")
        else:
            if level - upto >= GATHER:
                rows = levels.since(upto).select("node", "grp", "mask")
                rows = rows if gathered is None else rows.union(gathered)
                gathered, upto = levels.table(rows.groupBy("node", "grp").agg(F.bit_or("mask").alias("mask")), "node", "grp"), level + 1
            known = levels.since(upto).select("node", "grp", "mask")
            known = known if gathered is None else known.union(gathered)
        fresh = next_masks(dealt, levels.since(level), known, hubs, n <= BROADCAST_ROWS)
        level += 1
        n = levels.add(fresh, level)
    return trials_of(levels.close())


def _go_on(links: DataFrame, levels: DataFrame, level: int, max_levels: int | None) -> DataFrame:
    """The levels so far, and the rest by regions from the last of them."""
    done = materialize(trials_of(levels))
    return bfs_regions(links, None, max_levels, start=done, front=level)


def region_bounds(links: DataFrame, parts: int) -> list[int]:
    """Greatest node ids of all regions but the last, so that regions of runs of ids have about equally many edges. A mergeable
    sketch of the sources gives them."""
    if parts < 2:
        return []
    found = links.agg(F.percentile_approx("src", [i / parts for i in range(1, parts)], 100 * parts).alias("b")).first()["b"]
    return sorted(set(found or []))


def search_region(edges: tuple[np.ndarray, np.ndarray], nodes: np.ndarray, dists: np.ndarray, starts: np.ndarray, most: int | None) -> np.ndarray:
    """Distances (nodes by trials, FAR where unreached) after the search from the flat places `starts` has come to its end.

    edges are places of sources and targets among the nodes. Places leave in order of distance, so that each is followed
    at its final distance within the region, and so many at a time that about FOLLOWED edges are.
    """
    n, trials = dists.shape
    order = np.argsort(edges[0], kind="stable")
    targets = edges[1][order]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(edges[0], minlength=n))])
    flat = dists.reshape(-1)
    kind = np.int32 if flat.size < 2**31 else np.int64
    waiting: dict[int, list[np.ndarray]] = {}
    for d in np.unique(flat[starts]):
        waiting[int(d)] = [starts[flat[starts] == d].astype(kind)]
    while waiting:
        d = min(waiting)
        at = np.unique(np.concatenate(waiting.pop(d)))
        at = at[flat[at] == d]
        if most is not None and d >= most:
            continue
        ends = np.cumsum(offsets[at // trials + 1] - offsets[at // trials])
        i = 0
        while i < len(at):
            done = int(ends[i - 1]) if i else 0
            # one place at least, whatever its edges
            j = max(i + 1, int(np.searchsorted(ends, done + FOLLOWED, "right")))
            node, trial = at[i:j] // trials, at[i:j] % trials
            k = offsets[node + 1] - offsets[node]
            total = int(k.sum())
            to = targets[np.repeat(offsets[node] - (np.cumsum(k) - k), k) + np.arange(total)] * trials + np.repeat(trial, k)
            to = np.unique(to[flat[to] > d + 1])
            flat[to] = d + 1
            if len(to):
                waiting.setdefault(d + 1, []).append(to.astype(kind))
            i = j
    return dists


WORK = "region int, node long, dists array<int>, message boolean"


def bfs_regions(edges: DataFrame, sources: DataFrame | None, max_levels: int | None = None, regions: int | None = None, hub_edges: int | None = None, start: DataFrame | None = None, front: int = 0) -> DataFrame:
    """(trial, node, dist), as bfs_masks, for graphs of many levels.

    Nodes lie in regions of runs of ids with about REGION_EDGES edges at most. In each step every region takes what has come
    in, searches itself to the end for all trials, and sends what it has reached first or nearer in other regions; distances
    may still fall when a shorter way comes in later. A hub's edges lie with their targets instead, and its distances go to
    all regions. The search ends when nothing is sent. Trials are searched 64 at a time, or fewer where regions are large,
    so that a task's distances stay near REGION_PLACES numbers. With `start`, known distances, it goes on from those of
    distance `front`.
    """
    spark = edges.sparkSession
    links = materialize(clean_edges(edges))
    n_links = links.count()
    parts = regions or max(parallelism(spark), -(-n_links // REGION_EDGES))
    at_once = max(1, min(BITS, REGION_PLACES // max(n_links // parts, 1)))
    bounds = region_bounds(links, parts)
    # at most four for each partition
    hubs = [r["node"] for r in find_hubs(links, hub_edges).select("node").collect()]
    ends = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")

    def region(node: str) -> Column:
        return range_bucket(F.col(node), ends).cast("int")

    home = region("src") if not hubs else F.when(F.col("src").isin(hubs), region("dst")).otherwise(region("src"))
    levels = _Levels(spark)
    placed = levels.table(links.select(home.alias("region"), "src", "dst"), "region")
    if start is None:
        start = sources.select("trial", "node", F.lit(0).alias("dist")).where("trial is not null and node is not null").distinct()
    start = materialize(start.select(F.floor(F.col("trial") / at_once).cast("long").alias("grp"), F.pmod(F.col("trial"), F.lit(at_once)).cast("int").alias("t"), "node", "dist"))
    out = None
    # a row for each group of trials
    for group in start.groupBy("grp").agg(F.max("t").alias("t")).orderBy("grp").collect():
        some = start.where(F.col("grp") == group["grp"])
        state = some.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("t", "dist"))).alias("known"), F.max((F.col("dist") == front).cast("int")).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(group["t"])), lambda t: F.coalesce(F.try_element_at("known", t), F.lit(int(FAR))))
        state = state.select(region("node").alias("region"), "node", dense.alias("dists"), (F.col("m") == 1).alias("message"))
        if hubs:
            ghosts = state.where(F.col("node").isin(hubs) & F.col("message")).withColumn("region", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
            state = state.unionByName(ghosts.where(F.col("region") != region("node")))
        work = _search(placed, materialize(state), bounds, hubs, max_levels)
        found = work.where("not message").select("node", F.posexplode("dists").alias("t", "dist")).where(F.col("dist") < int(FAR))
        found = found.select((F.lit(group["grp"] * at_once) + F.col("t")).cast("long").alias("trial"), "node", "dist")
        out = found if out is None else out.union(found)
    levels.drop()
    return out if out is not None else spark.createDataFrame([], "trial long, node long, dist int")


def _search(placed: DataFrame, work: DataFrame, bounds: list[int], hubs: list[int], most: int | None) -> DataFrame:
    """Rows of states once no region sends any more."""
    borders, shared = np.array(bounds, np.int64), np.array(sorted(hubs), np.int64)

    def run(key, edges: pa.Table, rows: pa.Table) -> pa.Table:
        me, is_new = key[0].as_py(), rows["message"].to_numpy()
        if not is_new.any():
            return rows
        known = rows["dists"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        at = np.concatenate([edges["src"].to_numpy(), edges["dst"].to_numpy(), rows["node"].to_numpy()])
        nodes, place = np.unique(at, return_inverse=True)
        n = edges.num_rows
        dists = np.full((len(nodes), known.shape[1]), FAR, np.int32)
        seat = place[2 * n :]
        dists[seat[~is_new]] = known[~is_new]
        home = np.searchsorted(borders, nodes)
        own, hub = home == me, np.flatnonzero(np.isin(nodes, shared))
        told_before = dists[hub]
        # nodes that messages are about, and what they bring
        about, which = np.unique(seat[is_new], return_inverse=True)
        came = dists[about]
        np.minimum.at(came, which, known[is_new])
        row, trial = np.nonzero(came < dists[about])
        dists[about] = came
        del at, rows, known
        dists = search_region((place[:n], place[n : 2 * n]), nodes, dists, about[row] * dists.shape[1] + trial, most)
        reached = dists.min(axis=1) < FAR
        kept = np.flatnonzero(own & reached)
        # of other regions' nodes only messages about hubs came in
        foreign = ~own & reached
        foreign[about[(dists[about] == came).all(axis=1)]] = False
        sent = np.flatnonzero(foreign)
        parts = [(np.full(len(kept), me), kept, False), (home[sent], sent, True)]
        # a hub's owner tells all other regions, which hold its edges, what it has learnt
        told = hub[own[hub] & (dists[hub] < told_before).any(axis=1)]
        parts += [(np.full(len(told), j), told, True) for j in range(len(borders) + 1) if j != me and len(told)]
        to, rows_of = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        message = np.concatenate([np.full(len(p[1]), p[2]) for p in parts])
        flat = dists[rows_of].reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows_of) + 1, dtype=np.int32) * dists.shape[1]), pa.array(flat))
        return pa.table({"region": pa.array(to.astype(np.int32)), "node": pa.array(nodes[rows_of]), "dists": lists, "message": pa.array(message)})

    ship()
    while True:
        sent = Observation()
        step = placed.groupBy("region").cogroup(work.groupBy("region")).applyInArrow(run, WORK)
        work = materialize(step.observe(sent, F.sum(F.col("message").cast("int")).alias("n")))
        if not sent.get["n"]:
            return work
