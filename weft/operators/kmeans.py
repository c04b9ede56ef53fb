"""K-means by Lloyd's iterations with given first centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import materialize_by, ship

#: Numbers of the centroids that may be sent to all tasks.
MOST_VALUES = 4_000_000


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance); of clusters equally near the first.

    One matrix product tells the near clusters; where several are near within rounding, their distances are worked out
    from squared differences, as is every distance that is given.
    """
    size, own = (points**2).sum(axis=1), (centroids**2).sum(axis=1)
    rough = size[:, None] - 2 * points @ centroids.T + own
    owner = rough.argmin(axis=1)
    slack = 1e-9 * (size + own.max()) + 1e-12
    close = rough <= (rough.min(axis=1) + slack)[:, None]
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        at = np.flatnonzero(close[i])
        owner[i] = at[((points[i] - centroids[at]) ** 2).sum(axis=1).argmin()]
    return owner, ((points - centroids[owner]) ** 2).sum(axis=1)


def _check(centroids: np.ndarray) -> np.ndarray:
    centroids = np.asarray(centroids, float)
    if centroids.ndim != 2 or not len(centroids):
        raise ValueError("there must be a centroid at least, all of one length")
    if centroids.size > MOST_VALUES:
        raise ValueError(f"centroids of {centroids.size} values are too many to send to each task")
    return centroids


def assign(points: DataFrame, centroids: np.ndarray, id_col: str, features: str) -> DataFrame:
    """(id, cluster, dist2) of every point; points that are null or of another length are left out."""
    centroids = _check(centroids)
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    kind = points.schema[id_col].dataType.simpleString()
    rows = points.select(F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("x")).where(F.size("x") == centroids.shape[1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                owner, d = _nearest(np.stack(f["x"].to_numpy()), shared.value)
                yield pd.DataFrame({"id": f["id"], "cluster": owner.astype(np.int32), "dist2": d})

    ship()
    return rows.mapInPandas(run, f"id {kind}, cluster int, dist2 double")


def step(points: DataFrame, centroids: np.ndarray, features: str) -> DataFrame:
    """(cluster, n, centroid): the mean of each cluster's points; a cluster without points goes to the origin.

    Each task adds up its own points, so that only a row for each cluster and task is shuffled.
    """
    centroids = _check(centroids)
    spark = points.sparkSession
    k, d = centroids.shape
    shared = spark.sparkContext.broadcast(centroids)
    rows = points.select(F.col(features).cast("array<double>").alias("x")).where(F.size("x") == d)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, np.int64), np.zeros((k, d))
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy())
                owner, _ = _nearest(x, shared.value)
                n += np.bincount(owner, minlength=k)
                for j in range(d):
                    total[:, j] += np.bincount(owner, weights=x[:, j], minlength=k)
        at = np.flatnonzero(n)
        # a task without points has no rows: Arrow makes no lists of an empty column
        if len(at):
            yield pd.DataFrame({"cluster": at.astype(np.int32), "n": n[at], "total": list(total[at])})

    ship()
    parts = rows.mapInPandas(run, "cluster int, n bigint, total array<double>")
    sums = parts.select("cluster", F.posexplode("total").alias("j", "v")).groupBy("cluster", "j").agg(F.sum("v").alias("v"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("total"))
    sizes = parts.groupBy("cluster").agg(F.sum("n").alias("n"))
    mean = sums.join(sizes, "cluster").select("cluster", "n", F.transform("total", lambda v: v / F.col("n")).alias("centroid"))
    every = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    origin = F.array(*[F.lit(0.0)] * d)
    return every.join(mean, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("centroid", origin).alias("centroid"))


def fit(points: DataFrame, centroids: np.ndarray, features: str, iterations: int, threshold: float | None = None) -> np.ndarray:
    """Centroids after a set number of steps; with a threshold also earlier, once no centroid moves by more than it."""
    centroids = _check(centroids)
    for _ in range(iterations):
        rows = step(points, centroids, features).collect()
        after = np.array([r["centroid"] for r in sorted(rows, key=lambda r: r["cluster"])])
        moved = float(np.sqrt(((after - centroids) ** 2).sum(axis=1)).max())
        centroids = after
        if threshold is not None and moved <= threshold:
            break
    return centroids


#: Points of a block, and columns of a block's state.
BLOCK = 4_096
STATE = "block long, cluster binary, upper binary, lower binary, own int, n long, total array<double>, moved long, distances long"


def pack(points: DataFrame, features: str) -> DataFrame:
    """(block, d, x): points in blocks of up to BLOCK, as rows of doubles, in a table bucketed by block. Points that are null
    or hold a null are left out, as are those of another length than the most frequent one's."""
    rows = points.select(F.col(features).cast("array<double>").alias("x")).where("x is not null and forall(x, v -> v is not null)")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes["d"] if sizes else 0

    def run(batches):
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([d], pa.int32()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["block", "d", "x"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= BLOCK:
                yield block()
                number, held, n = number + 1, [], 0
        if held:
            yield block()

    ship()
    return materialize_by(rows.where(F.size("x") == d).mapInArrow(run, "block long, d int, x binary"), "block")[0]


def _reassign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Brings a block's clusters and bounds up to date in place; gives how many distances were worked out.

    A point stays without any distance if its upper bound is below half the way from its centroid to the next one or below
    its lower bound on all others; if that only holds for its true distance, one is enough.
    """
    k = len(centroids)
    between = np.sqrt(((centroids[:, None] - centroids) ** 2).sum(axis=2)) if k > 1 else np.full((1, 1), np.inf)
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1) / 2
    slack = 1e-9 * (1 + np.sqrt((centroids**2).sum(axis=1).max()))
    fresh = cluster < 0
    least = np.where(fresh, -np.inf, np.maximum(half[cluster], lower))
    far = np.flatnonzero(fresh | (upper >= least - slack))
    known = far[~fresh[far]]
    upper[known] = np.sqrt(((x[known] - centroids[cluster[known]]) ** 2).sum(axis=1))
    done = len(known)
    far = far[fresh[far] | (upper[far] >= least[far] - slack)]
    if len(far):
        owner, d2 = _nearest(x[far], centroids)
        cluster[far], upper[far] = owner, np.sqrt(d2)
        rough = np.maximum((x[far] ** 2).sum(axis=1)[:, None] - 2 * x[far] @ centroids.T + (centroids**2).sum(axis=1), 0)
        rough[np.arange(len(far)), owner] = np.inf
        # rounding of a difference of squares, taken off to stay below
        lower[far] = np.sqrt(np.maximum(rough.min(axis=1) - 1e-9 * ((x[far] ** 2).sum(axis=1) + 1), 0)) if k > 1 else np.inf
        done += len(far) * k
    return done


def bounded_fit(points: DataFrame, centroids: np.ndarray, features: str, iterations: int, delta: float | None = None) -> tuple[np.ndarray, list[dict]]:
    """(centroids, trace): Lloyd's steps with each point's cluster and bounds kept from step to step.

    Points are read once and lie in blocks; a step joins a block to its state in the same bucket and writes the new state
    and, for each task, the sums of its clusters, which are all that leaves it. By the triangle inequality a point's distances
    are only worked out where centroids have moved enough to matter. The trace has iteration, n, moved (points that
    changed cluster; all in the first), delta (their share) and distances (worked out) of each step. With `delta` the fit ends
    after the first step whose share is at most that. A cluster without points goes to the origin.
    """
    centroids = _check(centroids)
    spark = points.sparkSession
    blocks = pack(points, features).where(F.col("d") == centroids.shape[1])
    k, dims = centroids.shape
    state, drift, trace = None, np.zeros(k), []
    for iteration in range(1, iterations + 1):
        rows = blocks if state is None else blocks.join(state, "block")
        run = _bounded_step(centroids, drift, dims)
        new, _ = materialize_by(rows.select("block", "x", *([F.lit(None).cast("binary").alias(c) for c in ("cluster", "upper", "lower")] if state is None else ["cluster", "upper", "lower"])).mapInArrow(run, STATE), "block", partition_by="own")
        sums = new.where(F.col("own") >= 0).groupBy("own").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(j))) for j in range(dims)]).alias("total"), F.sum("moved").alias("moved"), F.sum("distances").alias("distances")).collect()
        after = np.zeros((k, dims))
        for r in sums:
            if r["own"] < k and r["n"]:
                after[r["own"]] = np.array(r["total"]) / r["n"]
        n, moved = sum(r["n"] for r in sums), sum(r["moved"] for r in sums)
        trace.append({"iteration": iteration, "n": n, "moved": moved, "delta": moved / n if n else 0.0, "distances": sum(r["distances"] for r in sums)})
        drift, centroids = np.sqrt(((after - centroids) ** 2).sum(axis=1)), after
        state = new.where(F.col("own") < 0).select("block", "cluster", "upper", "lower")
        if delta is not None and trace[-1]["delta"] <= delta:
            break
    return centroids, trace


def _bounded_step(centroids: np.ndarray, drift: np.ndarray, dims: int) -> Callable:
    k = len(centroids)
    # what any other centroid than one's own can have come nearer by
    order = np.argsort(-drift, kind="stable")
    others = np.full(k, drift[order[0]])
    others[order[0]] = drift[order[1]] if k > 1 else 0.0

    def run(batches):
        n, total, moved, worked = np.zeros(k, np.int64), np.zeros((k, dims)), np.zeros(k, np.int64), 0
        for batch in batches:
            out = []
            for block, raw, *old in zip(*[batch.column(c).to_pylist() for c in ("block", "x", "cluster", "upper", "lower")]):
                x = np.frombuffer(raw).reshape(-1, dims)
                if old[0] is None:
                    cluster, upper, lower = np.full(len(x), -1, np.int32), np.full(len(x), np.inf), np.zeros(len(x))
                else:
                    cluster, upper, lower = (np.frombuffer(b, t).copy() for b, t in zip(old, (np.int32, np.float64, np.float64)))
                    upper += drift[cluster]
                    lower -= others[cluster]
                before = cluster.copy()
                worked += _reassign(x, centroids, cluster, upper, lower)
                n += np.bincount(cluster, minlength=k)
                moved += np.bincount(cluster[cluster != before], minlength=k)
                for j in range(dims):
                    total[:, j] += np.bincount(cluster, weights=x[:, j], minlength=k)
                out.append((block, cluster.tobytes(), upper.tobytes(), lower.tobytes(), -1, None, None, None, None))
            yield _state_rows(out)
        yield _state_rows([(-1, None, None, None, c, int(n[c]), total[c].tolist(), int(moved[c]), worked if not c else 0) for c in range(k)])

    ship()
    return run


def _state_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def membership_change(points: DataFrame, old: np.ndarray, new: np.ndarray, id_col: str, features: str) -> DataFrame:
    """(n, moved, delta): points, points that change cluster between two sets of centroids, and their share."""
    a = assign(points, old, id_col, features).select("id", F.col("cluster").alias("a"))
    b = assign(points, new, id_col, features).select("id", F.col("cluster").alias("b"))
    moved = F.sum((F.col("a") != F.col("b")).cast("long"))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), moved.alias("moved"), (moved / F.count(F.lit(1))).alias("delta"))


def first_points(points: DataFrame, id_col: str, features: str, k: int) -> np.ndarray:
    """The k points of least id, as centroids."""
    rows = points.where(F.col(features).isNotNull()).orderBy(id_col).select(F.col(features).cast("array<double>").alias("x")).limit(k).collect()
    return np.array([r["x"] for r in rows])


def uniform_points(k: int, dims: int, low: float = 0.0, high: float = 100.0, seed: int = 33) -> np.ndarray:
    """k centroids whose values lie evenly from low to below high, the same for a seed."""
    return np.random.default_rng(seed).uniform(low, high, (k, dims))


def centroid_frame(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """(cluster, j, value), a row for each number."""
    rows = [(i, j, float(v)) for i, c in enumerate(centroids) for j, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, j int, value double")
