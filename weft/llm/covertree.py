"""Exact embedding near-duplicate detection by dual traversal of cover trees."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import least_hashes, map_batches, read, ship
from weft.operators.components import connected_components
from weft.session import materialize

#: Vectors of a block, for which one tree is built; pivots of the top level, and rows that they are chosen from.
BLOCK, PIVOTS, SAMPLE = 6000, 256, 4096
#: A node with so few vectors is a leaf and is compared vector by vector.
LEAF = 16
#: Guards against rounding: of single precision products, for each dimension, and of bounds in double precision.
SLACK32, SLACK = 2.4e-7, 1e-9


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def cover(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres (indices, the first of the points among them) such that each point is within `radius` of its centre,
    while centres lie further apart than that; and each point's centre, as a place in the list of centres."""
    n = len(points)
    owner = np.full(n, -1)
    centres: list[int] = []
    open_rows = np.arange(n)
    while len(open_rows):
        batch = open_rows[:256]
        near = gaps(points[batch], points[batch]) <= radius
        taken = np.zeros(len(batch), bool)
        chosen = []
        for i in range(len(batch)):
            if not taken[i]:
                chosen.append(i)
                taken |= near[i]
        picked = batch[chosen]
        d = gaps(points[open_rows], points[picked])
        best = d.argmin(axis=1)
        inside = d[np.arange(len(open_rows)), best] <= radius
        inside[np.searchsorted(open_rows, picked)] = True
        best[np.searchsorted(open_rows, picked)] = np.arange(len(picked))
        owner[open_rows[inside]] = best[inside] + len(centres)
        centres += picked.tolist()
        open_rows = open_rows[~inside]
    return np.array(centres), owner


class CoverTree:
    """Nested levels with halving radii over unit vectors, in an order in which each node's vectors lie together.

    Node i holds the vectors from lo[i] to hi[i], its centre is vector centre[i], no vector of it is further from the
    centre than radius[i], and its children are the nodes from first[i] to last[i]. Node 0 is the root.
    """

    def __init__(self, points: np.ndarray):
        order = np.arange(len(points))
        self.lo, self.hi, self.centre, self.radius, self.first, self.last = [0], [len(points)], [0], [0.0], [0], [0]
        todo = [(0, 2.0)]
        while todo:
            node, scale = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            rows = order[lo:hi]
            own = points[rows]
            self.centre[node] = lo
            self.radius[node] = float(gaps(own[:1], own).max()) if hi - lo > 1 else 0.0
            if hi - lo <= LEAF or scale < 1e-3 or self.radius[node] <= 1e-7:
                continue
            scale = min(scale, self.radius[node]) / 2
            centres, owner = cover(own, scale)
            # a centre comes first in its node
            lead = np.ones(len(rows))
            lead[centres] = 0
            arranged = np.lexsort((lead, owner))
            order[lo:hi] = rows[arranged]
            sizes = np.bincount(owner, minlength=len(centres))
            self.first[node] = len(self.lo)
            at = lo
            for size in sizes.tolist():
                self.lo.append(at)
                self.hi.append(at + size)
                self.centre.append(at)
                self.radius.append(0.0)
                self.first.append(0)
                self.last.append(0)
                if size > 1:
                    todo.append((len(self.lo) - 1, scale))
                at += size
            self.last[node] = len(self.lo)
        self.order = order
        self.points = points[order]
        self.single = self.points.astype(np.float32)
        for name in ("lo", "hi", "centre", "radius", "first", "last"):
            setattr(self, name, np.array(getattr(self, name)))


class Links:
    """Link counts of two blocks' vectors, and the least id that each reaches within them."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        self.n = np.zeros(len(ids), np.int64)
        self.up = np.arange(len(ids))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self, at: np.ndarray) -> np.ndarray:
        """The roots of these vectors, which point straight to them from now on."""
        top = self.up[at]
        while True:
            above = self.up[top]
            if np.array_equal(above, top):
                self.up[at] = top
                return top
            top = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i]: a step for each pair of classes that differ, not for each pair of vectors."""
        x, y = self.roots(a), self.roots(b)
        differ = x != y
        if differ.any():
            for key in np.unique(np.minimum(x, y)[differ] * len(self.up) + np.maximum(x, y)[differ]).tolist():
                i, j = self.root(key // len(self.up)), self.root(key % len(self.up))
                if i != j:
                    if self.ids[j] < self.ids[i]:
                        i, j = j, i
                    self.up[j] = i

    def whole(self, a: range, b: range) -> None:
        """Every vector of a links with every vector of b."""
        self.n[a.start : a.stop] += self.counts[b.start : b.stop].sum()
        self.n[b.start : b.stop] += self.counts[a.start : a.stop].sum()
        self.join(np.arange(a.start, a.stop), np.full(len(a), b.start))
        self.join(np.arange(b.start, b.stop), np.full(len(b), a.start))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.n, a, self.counts[b])
        np.add.at(self.n, b, self.counts[a])
        if len(a):
            self.join(a, b)


def dual_traversal(a: CoverTree, b: CoverTree, links: Links, shift: int, cosine: float) -> None:
    """Adds to `links` all pairs of a vector of a and one of b (numbered from `shift` on) of at least that cosine.

    a is b compares the pairs within one tree. A pair of nodes is dropped if even their nearest vectors must be too far
    apart, counted as a whole if even the furthest are near enough, and else opened into its children.
    """
    own = a is b
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    slack = SLACK32 * (a.points.shape[1] + 4)
    todo = [(0, 0)]

    def kids(tree: CoverTree, node: int) -> np.ndarray:
        return np.arange(tree.first[node], tree.last[node]) if tree.last[node] > tree.first[node] else np.array([node])

    def leaf(tree: CoverTree, node: int) -> bool:
        return tree.last[node] == tree.first[node]

    while todo:
        x, y = todo.pop()
        if leaf(a, x) and leaf(b, y):
            lo, lo2 = a.lo[x], b.lo[y]
            left, right = np.nonzero(a.points[lo : a.hi[x]] @ b.points[lo2 : b.hi[y]].T >= cosine)
            left, right = left + lo, right + lo2
            if own and x == y:
                left, right = left[left < right], right[left < right]
            links.pairs(left, right + shift)
            continue
        same = own and x == y
        # the node of the larger radius is opened, both if they are alike
        open_a = not leaf(a, x) and (same or leaf(b, y) or a.radius[x] * 2 >= b.radius[y])
        open_b = not leaf(b, y) and (same or leaf(a, x) or b.radius[y] * 2 >= a.radius[x])
        left = kids(a, x) if open_a else np.array([x])
        right = kids(b, y) if open_b else np.array([y])
        flat = b.radius[right] == 0
        for part in (right[flat], right[~flat]):
            for at in range(0, len(left), 1024):
                rows = left[at : at + 1024]
                if not len(part) or not len(rows):
                    continue
                product = a.single[a.centre[rows]] @ b.single[b.centre[part]].T
                if not a.radius[rows].any() and not b.radius[part].any():
                    i, j = np.nonzero(product >= np.float32(cosine - slack))
                else:
                    # a distance of at most `limit` is a cosine of at least 1 - limit**2 / 2
                    limit = np.minimum(reach + a.radius[rows][:, None] + b.radius[part][None, :], 2.0)
                    i, j = np.nonzero(product >= 1.0 - limit**2 / 2 - slack)
                p, q = rows[i], part[j]
                if same:
                    p, q = p[p <= q], q[p <= q]
                if not len(p):
                    continue
                exact = np.einsum("ij,ij->i", a.points[a.centre[p]], b.points[b.centre[q]])
                far = np.sqrt(np.maximum(2.0 - 2.0 * exact, 0.0)) + a.radius[p] + b.radius[q]
                ones = (a.hi[p] - a.lo[p] == 1) & (b.hi[q] - b.lo[q] == 1)
                hit = ones & (exact >= cosine)
                if own:
                    hit &= p != q
                links.pairs(a.lo[p[hit]], b.lo[q[hit]] + shift)
                for u, v, f, one in zip(p.tolist(), q.tolist(), far.tolist(), ones.tolist()):
                    if one:
                        continue
                    if f <= reach - SLACK and not (own and u == v):
                        links.whole(range(a.lo[u], a.hi[u]), range(b.lo[v] + shift, b.hi[v] + shift))
                    else:
                        todo.append((u, v))


def _units(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, k, u, d): digest, bytes and length of each usable vector, scaled to length 1 in double precision."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("id is not null")

    def run(batches):
        for batch in batches:
            ids, keys, units, dims = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not v or None in v:
                    continue
                x = np.array(v, np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    big = np.abs(x).max()
                    if not np.isfinite(big) or big == 0:
                        continue
                    x = x / big
                    x = x / np.sqrt(x @ x)
                ids.append(i)
                keys.append(hashlib.md5((x + 0.0).tobytes()).digest())
                units.append((x + 0.0).tobytes())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(dims, pa.int32())], names=["id", "k", "u", "d"])

    return map_batches(rows, run, f"id {kind}, k binary, u binary, d int")


def spread_pivots(points: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` points, each the furthest from those before it: the top of the tree."""
    chosen = [0]
    d = gaps(points, points[:1])[:, 0]
    while len(chosen) < min(most, len(points)) and d.max() > 1e-3:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, gaps(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component) per row: how many other rows' vectors have at least that cosine, and the least id that
    links reach.

    All comparisons are in double precision and exact. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, and neither do rows without an id; only vectors of one length link. Equal vectors are
    folded first and link with each other. The rows are dealt to the nearest of at most PIVOTS pivots, a pivot's rows
    into blocks of BLOCK, a tree is built for each block, and pairs of blocks whose covering radii let them reach each
    other are traversed, each pair in a task. Rows that share an id count as several vectors with equal results.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    units = materialize(_units(vectors, id_col, vector_col))
    folded = materialize(units.groupBy("d", "k").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("u").alias("u")))

    pivots: dict[int, np.ndarray] = {}
    blocks: dict[int, int] = {}
    for d, n in sorted((r["d"], r["n"]) for r in folded.groupBy("d").count().withColumnRenamed("count", "n").collect()):
        sample = least_hashes(folded.where(F.col("d") == d), SAMPLE, "k").select("k", "u").collect()
        sample.sort(key=lambda r: bytes(r["k"]))
        points = np.stack([np.frombuffer(r["u"]) for r in sample])
        blocks[d] = -(-n // BLOCK)
        pivots[d] = spread_pivots(points, min(PIVOTS, max(1, blocks[d])))
    if not pivots:
        return vectors.select(F.col(f"`{id_col}`").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(f"`{id_col}`").alias("component"))
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            cells, far = [], []
            for u, d in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                gap = gaps(np.frombuffer(u)[None, :], shared.value[d])[0]
                cells.append(int(gap.argmin()))
                far.append(float(gap.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(far, pa.float64())], names=["id", "u", "n", "d", "cell", "far"])

    dealt = materialize(map_batches(folded.select("id", "u", "n", "d"), assign, f"id {kind}, u binary, n bigint, d int, cell int, far double"))
    # at most PIVOTS rows for each length of vectors
    cells = dealt.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("r")).withColumn("subs", F.ceil(F.col("rows") / BLOCK).cast("int"))
    blocked = dealt.join(F.broadcast(cells.select("d", "cell", "subs")), ["d", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id", "u"), F.col("subs")).cast("int"))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        tree = CoverTree(np.stack([np.frombuffer(u) for u in pdf["u"]]))
        ids, n = pdf["id"].to_numpy()[tree.order], pdf["n"].to_numpy()[tree.order]
        # plain arrays: the class itself may not be there when they are read
        tree_parts = {k: getattr(tree, k) for k in ("points", "lo", "hi", "centre", "radius", "first", "last")}
        return pd.DataFrame({"d": [int(pdf["d"].iloc[0])], "cell": [int(pdf["cell"].iloc[0])], "sub": [int(pdf["sub"].iloc[0])], "tree": [pickle.dumps((tree_parts, ids, n))]})

    ship()
    trees = materialize(blocked.groupBy("d", "cell", "sub").applyInPandas(plant, "d int, cell int, sub int, tree binary"))

    meets = []
    of_cell = {(r["d"], r["cell"]): r for r in cells.collect()}
    for d, points in pivots.items():
        own = sorted(c for e, c in of_cell if e == d)
        gap = gaps(points, points)
        reach = np.sqrt(2 - 2 * cosine)
        meets += [(d, i, of_cell[d, i]["subs"], j, of_cell[d, j]["subs"]) for i in own for j in own if i <= j and gap[i, j] <= reach + of_cell[d, i]["r"] + of_cell[d, j]["r"] + 1e-6]
    wanted = spark.createDataFrame(meets, "d int, ca int, na int, cb int, nb int")
    wanted = wanted.select("d", "ca", "cb", "nb", F.explode(F.expr("sequence(0, na - 1)")).alias("sa"))
    wanted = wanted.select("d", "ca", "sa", "cb", F.explode(F.expr("sequence(0, nb - 1)")).alias("sb")).where("ca < cb or sa <= sb")
    left = trees.select("d", F.col("cell").alias("ca"), F.col("sub").alias("sa"), F.col("tree").alias("ta"))
    right = trees.select("d", F.col("cell").alias("cb"), F.col("sub").alias("sb"), F.col("tree").alias("tb"))

    def walk(batches):
        def plain(data):
            parts, ids, n = pickle.loads(data)
            tree = CoverTree.__new__(CoverTree)
            tree.__dict__.update(parts)
            tree.single = tree.points.astype(np.float32)
            return tree, ids, n

        for batch in batches:
            for same, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                a, ids, n = plain(ta.as_py())
                shift = 0
                if same:
                    b = a
                else:
                    b, more, m = plain(tb.as_py())
                    shift = len(ids)
                    ids, n = np.concatenate([ids, more]), np.concatenate([n, m])
                links = Links(ids, n)
                dual_traversal(a, b, links, shift, cosine)
                at = np.flatnonzero(links.n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links.n[at], pa.int64()), pa.array(ids[links.roots(at)])], names=["id", "n", "root"])

    pairs = wanted.hint("shuffle_hash").join(left, ["d", "ca", "sa"]).join(right, ["d", "cb", "sb"])
    pairs = pairs.select(F.expr("ca = cb and sa = sb").alias("same"), "ta", "tb")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    ship()
    # a row holds two blocks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        found = materialize(pairs.mapInArrow(walk, f"id {kind}, n bigint, root {kind}"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    labels = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = folded.select("d", "k", F.col("id").alias("rep"), "n").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("d", "k", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    rows = units.select("id", "d", "k").join(known, ["d", "k"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    ids = vectors.select(F.col(f"`{id_col}`").alias("id"))
    return ids.join(rows, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: its links, the least id that links reach, and whether that is its own."""
    found = embedding_links(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
