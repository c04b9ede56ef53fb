"""Hard negatives by inner product: vantage-point trees over norm-augmented vectors, searched nearest-first in annuli.

With M the greatest squared norm, a vector x becomes (x, sqrt(M - |x|^2)) and an anchor a becomes (a, 0). Their squared
distance is |a|^2 + M - 2 a.x, so greater scores are nearer, and a window of scores is an annulus around the anchor. The
triangle inequality bounds the scores of all vectors whose distances from a vantage point are known.

A small tree that all tasks know deals the vectors to cells; cells are cut into chunks of about CHUNK_ROWS vectors, and each
chunk gets a tree of its own in the task that searches it. An anchor visits only chunks of cells that may hold what it
wants. Scores are exact: bounds are only used to leave out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.llm.common import least_hashes, map_batches, read
from weft.session import materialize, parallelism

#: Vectors of a chunk and of a leaf of its tree.
CHUNK_ROWS, LEAF_ROWS = 8_192, 64
#: Vectors that the upper tree is fitted on, and its greatest depth; every vector is dealt by it.
SAMPLE, DEPTH = 4_096, 8
#: Positives of an anchor, negatives of a positive, percentages of the positive's score between which a negative's lies.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100


def distances(x: np.ndarray, h: np.ndarray, v: np.ndarray, hv: np.ndarray) -> np.ndarray:
    """Distances of augmented vectors (x, h) from augmented vectors (v, hv), a row for each x."""
    d2 = (x**2).sum(axis=1)[:, None] + (v**2).sum(axis=1) - 2 * x @ v.T + (h[:, None] - hv) ** 2
    return np.sqrt(np.maximum(d2, 0))


def height(x: np.ndarray, most: float) -> np.ndarray:
    """The added component of each row of x; most is the greatest squared norm."""
    return np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))


class VantageTree:
    """A tree over augmented vectors. Nodes are numbered from the root with parents first; each but the root knows between
    which distances from its parent's vantage point its vectors lie."""

    def __init__(self, x: np.ndarray, most: float, leaf: int = LEAF_ROWS, depth: int = 64, seed: int = 1):
        self.x, self.h, self.most = x, height(x, most), most
        rng = np.random.default_rng(seed)
        self.parent, self.low, self.high, self.vantage, self.cut = [-1], [0.0], [np.inf], [-1], [0.0]
        self.kids: list[tuple[int, int] | None] = [None]
        self.rows: list[np.ndarray] = [np.arange(len(x))]
        self.level = [0]
        at = 0
        while at < len(self.rows):
            rows = self.rows[at]
            if len(rows) > leaf and self.level[at] < depth:
                # a vector far from some other one sees the rest at unlike distances
                first = rows[rng.integers(len(rows))]
                vantage = rows[self._from(first, rows).argmax()]
                d = self._from(vantage, rows)
                order = np.argsort(d, kind="stable")
                half = len(rows) // 2
                self.vantage[at], self.cut[at] = int(vantage), float(d[order[half]])
                self.kids[at] = (len(self.rows), len(self.rows) + 1)
                for part in (order[:half], order[half:]):
                    self.parent.append(at)
                    self.low.append(float(d[part].min()))
                    self.high.append(float(d[part].max()))
                    self.rows.append(rows[part])
                    self.vantage.append(-1)
                    self.cut.append(0.0)
                    self.kids.append(None)
                    self.level.append(self.level[at] + 1)
                self.rows[at] = rows[:0]
            at += 1

    def _from(self, one: int, rows: np.ndarray) -> np.ndarray:
        return distances(self.x[rows], self.h[rows], self.x[one : one + 1], self.h[one : one + 1])[:, 0]


def score_bounds(own: np.ndarray, da: np.ndarray, low: np.ndarray, high: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) scores that vectors between distances low and high from a vantage point can have with anchors
    of squared norm `own` at distance `da` from it. Slack covers rounding."""
    slack = 1e-6 * (np.sqrt(most) + 1)
    near = np.maximum(np.maximum(low - da, da - high) - slack, 0)
    far = da + high + slack
    return (own + most - far**2) / 2 - 1, (own + most - near**2) / 2 + 1


def node_bounds(tree: VantageTree, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of every node's vectors with every anchor: (nodes, anchors) each. A node's bounds hold what its
    ancestors' say too."""
    n = len(tree.rows)
    least, greatest = np.full((n, len(anchors)), -np.inf), np.full((n, len(anchors)), np.inf)
    own = (anchors**2).sum(axis=1)
    inner = [i for i in range(n) if tree.kids[i] is not None]
    if not inner:
        return least, greatest
    v = [tree.vantage[i] for i in inner]
    da = dict(zip(inner, distances(anchors, np.zeros(len(anchors)), tree.x[v], tree.h[v]).T))
    for i in range(1, n):
        p = tree.parent[i]
        a, b = score_bounds(own, da[p], tree.low[i], tree.high[i], tree.most)
        least[i], greatest[i] = np.maximum(a, least[p]), np.minimum(b, greatest[p])
    return least, greatest


def nearest_first(tree: VantageTree, ids: np.ndarray, fits: np.ndarray, anchor: np.ndarray, least: np.ndarray, greatest: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (low, high) the first k (score, id) of the fitting rows with a score inside it, higher scores first,
    ties by smaller id.

    Nodes and rows leave one queue in order of what they can reach at best, so rows come in their final order, and the walk
    ends as soon as every window has its k rows or nothing left reaches one. Nodes outside all open windows are left out.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    open_ = [i for i, (a, b) in enumerate(windows) if a <= b]
    # (-best score, 0 for nodes and 1 for rows, id or number, what it is)
    queue: list[tuple] = [(-np.inf, 0, 0, None)]
    while queue and open_:
        best, is_row, n, run = heapq.heappop(queue)
        floor, roof = min(windows[i][0] for i in open_), max(windows[i][1] for i in open_)
        if -best < floor:
            break
        if is_row:
            score = -best
            for i in [i for i in open_ if windows[i][0] <= score <= windows[i][1]]:
                found[i].append((score, n))
                if len(found[i]) == k:
                    open_.remove(i)
            scores, own, at = run
            # rows of the same leaf follow; those above every open window are passed over
            at = max(at + 1, int(np.searchsorted(-scores, -roof))) if open_ else len(own)
            if at < len(own):
                heapq.heappush(queue, (-int(scores[at]), 1, int(own[at]), (scores, own, at)))
        elif tree.kids[n] is not None:
            for kid in tree.kids[n]:
                if any(greatest[kid] >= windows[i][0] and least[kid] <= windows[i][1] for i in open_):
                    heapq.heappush(queue, (-greatest[kid], 0, kid, None))
        else:
            rows = tree.rows[n]
            rows = rows[fits[rows]]
            scores = tree.x[rows] @ anchor
            keep = (scores >= floor) & (scores <= roof)
            scores, own = scores[keep], ids[rows[keep]]
            if len(own):
                order = np.lexsort((own, -scores))
                scores, own = scores[order], own[order]
                heapq.heappush(queue, (-int(scores[0]), 1, int(own[0]), (scores, own, 0)))
    return found


def usable(rows: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(id, label, v, k1, k2): rows that take part, v the whole components floor(256 x), k1 and k2 a 128-bit key of label
    and v. Rows with a null id, label, vector or component, or with a component that isn't finite, don't."""
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    out = out.where("id is not null and label is not null and x is not null").where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    v = F.transform("x", lambda c: F.floor(c * 256).cast("double"))
    return out.select("id", "label", v.alias("v")).select("*", F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.lit(5), "v", "label").alias("k2"))


def first_of_copies(rows: DataFrame, most: int) -> DataFrame:
    """rows without repeats, and of each group of equal label and vector those of the `most` smallest ids: no others can be
    among the first `most` of any order by score and id. Tasks leave out what they can before rows move."""
    order = Window.partitionBy("k1", "k2").orderBy("id")
    return rows.dropDuplicates(["k1", "k2", "id"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


class Cells:
    """The upper tree, over vectors of one length, and what is known of each cell: how many chunks it has and between which
    distances from the vantage points above it its vectors lie. Vectors of other lengths lie in cells of their own."""

    def __init__(self, dealt_by: VantageTree | None, size: int, most: float):
        self.size, self.most = size, most
        self.inner: list[int] = []
        if dealt_by is not None:
            # the sample that the tree was fitted on stays behind
            self.parent, self.kids, self.cut = dealt_by.parent, dealt_by.kids, dealt_by.cut
            self.inner = [i for i, kids in enumerate(dealt_by.kids) if kids is not None]
            at = [dealt_by.vantage[i] for i in self.inner]
            self.v, self.hv = dealt_by.x[at], dealt_by.h[at]
        self.stats: dict[int, list[tuple]] = {}

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """(cell, distances from the vantage points on the way down) of each vector."""
        node, path = np.zeros(len(x), np.int64), [[] for _ in range(len(x))]
        if self.inner:
            d = distances(x, height(x, self.most), self.v, self.hv)
            for j, i in enumerate(self.inner):
                here = np.flatnonzero(node == i)
                for r in here:
                    path[r].append(float(d[r, j]))
                near, far = self.kids[i]
                node[here] = np.where(d[here, j] < self.cut[i], near, far)
        return node, path

    def above(self, cell: int) -> list[int]:
        """Places in `inner` of the nodes above a cell, from the root."""
        out = []
        while cell > 0:
            cell = self.parent[cell]
            out.append(self.inner.index(cell))
        return out[::-1]

    def reachable(self, anchors: np.ndarray, windows: list[list[tuple[float, float]]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(cell, its chunks, places of the anchors with a window that a vector of the cell may lie in)."""
        size = anchors.shape[1]
        if size == self.size and self.inner:
            da = distances(anchors, np.zeros(len(anchors)), self.v, self.hv)
        own = (anchors**2).sum(axis=1)
        for cell, chunks, low, high in self.stats.get(size, []):
            least, greatest = np.full(len(anchors), -np.inf), np.full(len(anchors), np.inf)
            if size == self.size:
                for j, a, b in zip(self.above(cell), low, high):
                    x, y = score_bounds(own, da[:, j], a, b, self.most)
                    least, greatest = np.maximum(least, x), np.minimum(greatest, y)
            hit = [i for i, w in enumerate(windows) if any(greatest[i] >= a and least[i] <= b for a, b in w)]
            yield cell, chunks, np.array(hit, np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), len(values) // max(len(column), 1))


def segments(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that agree in all columns, as they come."""
    n = len(columns[0])
    if n:
        edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *edge.tolist(), n]
        yield from zip(bounds[:-1], bounds[1:])


def deal(rows: DataFrame) -> tuple[DataFrame, Cells, tuple]:
    """(rows with size, cell and salt, the cells, the sample): rows in chunks, written to the shared folder."""
    spark = rows.sparkSession
    rows = materialize(rows)
    by_size = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("most")).collect()
    most = max((r["most"] for r in by_size), default=0.0)
    if most >= 2.0**52:
        raise ValueError("components are too large: scores would not be exact")
    main = max(by_size, key=lambda r: (r["n"], r["size"]), default=None)
    size, n = (main["size"], main["n"]) if main else (0, 0)
    found = least_hashes(rows.where(F.size("v") == size), SAMPLE, "k1", "k2", "id").select("id", "label", "v").toArrow()
    sample = (matrix(found["v"]), found["label"].to_numpy())
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / CHUNK_ROWS)))))
    cells = Cells(VantageTree(sample[0], most, leaf=8, depth=depth) if len(sample[0]) and size else None, size, most)

    def run(batches):
        known = cells
        for batch in batches:
            lengths = batch.column("size").to_numpy()
            cell, path = np.full(len(lengths), -1, np.int64), [[] for _ in range(len(lengths))]
            at = np.flatnonzero(lengths == known.size)
            if len(at) and known.size:
                cell[at], found = known.place(matrix(batch.column("v").take(pa.array(at))))
                for i, p in zip(at, found):
                    path[i] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(path, pa.list_(pa.float64()))], names=[*batch.schema.names, "cell", "path"])

    sized = rows.select("id", "label", "v", F.size("v").alias("size"))
    placed = materialize(map_batches(sized, run, "id long, label long, v array<double>, size int, cell int, path array<double>"))
    levels = [F.get("path", F.lit(j)) for j in range(DEPTH)]
    stats = placed.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.min, levels)).alias("low"), F.array(*map(F.max, levels)).alias("high")).collect()
    for r in stats:
        low, high = ([d for d in r[c] if d is not None] for c in ("low", "high"))
        cells.stats.setdefault(r["size"], []).append((r["cell"], -(-r["n"] // CHUNK_ROWS), low, high))
    chunks = spark.createDataFrame([(r["size"], r["cell"], -(-r["n"] // CHUNK_ROWS)) for r in stats], "size int, cell int, chunks long")
    # a row for each cell and each length of vectors
    dealt = placed.join(F.broadcast(chunks), ["size", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    return dealt.select("size", "cell", "salt", "id", "label", "v"), cells, sample


ROUTED = "size int, cell int, salt int, k1 long, k2 long, label long, v array<double>, names array<long>, lows array<double>, highs array<double>"


def route(kinds: DataFrame, cells: Cells, sample: tuple | None, wanted: int) -> DataFrame:
    """A row for each anchor and chunk that it must visit. With a sample the anchors look for the nearest rows of their own
    label: what the `wanted`-th best of the sample scores bounds what can be among the first; else kinds have windows."""
    def floors(x: np.ndarray, labels: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -np.inf)
        for label in np.unique(labels):
            same = rows[own == label]
            if len(same) >= wanted:
                at = np.flatnonzero(labels == label)
                out[at] = np.partition(x[at] @ same.T, len(same) - wanted, axis=1)[:, len(same) - wanted]
        return out

    def run(batches):
        known, few = cells, sample
        names = [f.split()[0] for f in ROUTED.split(", ")]
        for whole in batches:
            lengths = whole.column("size").to_numpy()
            for size in np.unique(lengths):
                batch = whole.take(pa.array(np.flatnonzero(lengths == size)))
                x = matrix(batch.column("v"))
                if few is not None:
                    low = floors(x, batch.column("label").to_numpy(), *few) if size == known.size and size else np.full(len(x), -np.inf)
                    lows, highs, called = [[float(a)] for a in low], [[float("inf")]] * len(x), [[0]] * len(x)
                else:
                    lows, highs, called = (batch.column(c).to_pylist() for c in ("lows", "highs", "names"))
                held = [pa.array(called, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.float64())), pa.array(highs, pa.list_(pa.float64()))]
                base = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k1", "k2", "label", "v")], *held], names=names[3:])
                for cell, chunks, hit in known.reachable(x, [list(zip(a, b)) for a, b in zip(lows, highs)]):
                    if len(hit):
                        some = base.take(pa.array(hit))
                        for salt in range(chunks):
                            place = [pa.array(np.full(len(hit), c, np.int32)) for c in (size, cell, salt)]
                            yield pa.RecordBatch.from_arrays([*place, *some.columns], names=names)

    return map_batches(kinds.withColumn("size", F.size("v")), run, ROUTED)


def search(dealt: DataFrame, routed: DataFrame, most: float, same: bool, k: int) -> DataFrame:
    """(k1, k2, name, score, id): what each anchor finds in each chunk that it visits, the first k rows for each of its
    windows, told apart by their names; of its own label (same), or of others.

    Chunks and their visitors meet in one partition, vectors first, and are streamed: a task holds one chunk's tree and a
    batch of visitors.
    """
    rows = dealt.select("size", "cell", "salt", F.lit(0).alias("visits"), "id", "label", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("k1", "long"), ("k2", "long"), ("names", "array<long>"), ("lows", "array<double>"), ("highs", "array<double>"))])
    visits = routed.select("size", "cell", "salt", F.lit(1).alias("visits"), F.lit(None).cast("long").alias("id"), "label", "v", "k1", "k2", "names", "lows", "highs")
    both = rows.union(visits).repartition(parallelism(dealt.sparkSession), "size", "cell", "salt").sortWithinPartitions("size", "cell", "salt", "visits")

    def run(batches):
        chunk, held, tree = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("size", "cell", "salt", "visits")]
            out = []
            for a, b in segments(*keys):
                part, here = batch.slice(a, b - a), tuple(int(k[a]) for k in keys[:3])
                if here != chunk:
                    chunk, held, tree = here, [], None
                x = matrix(part.column("v"))
                labels = part.column("label").to_numpy()
                if not keys[3][a]:
                    held.append((x, part.column("id").to_numpy(), labels))
                    continue
                if not held:
                    continue
                if tree is None:
                    ids, own = (np.concatenate([h[i] for h in held]) for i in (1, 2))
                    tree = VantageTree(np.concatenate([h[0] for h in held]), most)
                least, greatest = node_bounds(tree, x)
                k1, k2, called, lows, highs = (part.column(c).to_pylist() for c in ("k1", "k2", "names", "lows", "highs"))
                for i, anchor in enumerate(x):
                    fits = own == labels[i] if same else own != labels[i]
                    for name, best in zip(called[i], nearest_first(tree, ids, fits, anchor, least[:, i], greatest[:, i], list(zip(lows[i], highs[i])), k)):
                        out += [(k1[i], k2[i], name, int(s), int(j)) for s, j in best]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=["k1", "k2", "name", "score", "id"])

    return map_batches(both, run, "k1 long, k2 long, name long, score long, id long")


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str, label: Column, vector_col: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    `positives` other rows of its label the first `negatives` rows of other labels whose score lies between `low` and `high`
    percent of the positive's. Higher scores come first, ties by smaller id; fewer where there are fewer.

    `anchors` is a condition on `id`. Rows with a null id, label, vector or component, or a component that isn't finite,
    take no part. Repeated rows count once; rows of one id with different labels or vectors are rows of their own, but
    never each other's positives. Vectors of different lengths have no score. Whole components are floor(256 x); it is an
    error if scores could pass 2^52. Anchors of equal label and vector are searched for once.
    """
    every = usable(rows, id_col, label, vector_col)
    wanted = materialize(every.where(anchors).dropDuplicates(["k1", "k2", "id"]))
    asking = wanted.select(F.col("id").alias("anchor_id"), "k1", "k2")
    kinds = materialize(wanted.select("k1", "k2", "label", "v").dropDuplicates(["k1", "k2"]))
    dealt, cells, sample = deal(first_of_copies(every, max(positives + 1, negatives)))
    best = Window.partitionBy("k1", "k2").orderBy(F.col("score").desc(), "id")
    near = search(dealt, route(kinds, cells, sample, positives + 1), cells.most, True, positives + 1)
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives + 1).select("k1", "k2", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    own = Window.partitionBy("anchor_id", "k1", "k2").orderBy(F.col("positive_score").desc(), "positive_id")
    pairs = asking.join(near, ["k1", "k2"]).where("positive_id <> anchor_id").withColumn("n", F.row_number().over(own)).where(F.col("n") <= positives)
    pairs = materialize(pairs.drop("n"))
    # a window of scores for each score that a positive has: at most positives + 1 for each kind of anchor
    ends = pairs.select("k1", "k2", F.col("positive_score").alias("p")).distinct()
    ends = ends.select("k1", "k2", F.struct(F.col("p"), F.ceil(F.col("p") * low / 100.0).cast("double").alias("a"), F.floor(F.col("p") * high / 100.0).cast("double").alias("b")).alias("w")).where("w.a <= w.b")
    ends = ends.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("w"), asc=False).alias("w"))
    windows = kinds.join(ends, ["k1", "k2"]).select("k1", "k2", "label", "v", F.col("w.p").alias("names"), F.col("w.a").alias("lows"), F.col("w.b").alias("highs"))
    ranked = Window.partitionBy("k1", "k2", "name").orderBy(F.col("score").desc(), "id")
    found = search(dealt, route(windows, cells, None, negatives), cells.most, False, negatives)
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    found = found.select("k1", "k2", F.col("name").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["k1", "k2", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of the rows whose id is divisible by 100, where ids divisible by 7
    have the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, "vec_id", label, "embedding")
