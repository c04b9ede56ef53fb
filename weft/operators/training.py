"""Data-parallel training of the search's linear classifier: tasks train on their own rows, weights are averaged in a tree.

Texts become hashed features once, in a table in the shared folder. In each round every task runs over its rows from the
weights that all begin with; what comes back are sums of weights by blocks of features, put together by a combiner. The driver
holds one model (FEATURES numbers) and no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.combine import combine
from weft.operators.gridsearch import FEATURES, L1_RATIO, PATIENCE, TOLERANCE, features
from weft.session import materialize, ship, spread

#: Features of a block of weights.
BLOCK = 4_096


@dataclass
class Model:
    """A linear classifier of hashed features, and the mean loss of each round of its training."""

    ngram_max: int
    norm: str
    weights: np.ndarray
    bias: float
    losses: list[float] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        """(place, weight) of the features with a weight; the intercept has place -1."""
        at = np.flatnonzero(self.weights)
        rows = pa.table({"place": pa.array(np.append(at, -1).astype(np.int32)), "weight": pa.array(np.append(self.weights[at], self.bias))})
        return spark.createDataFrame(rows)

    @staticmethod
    def load(rows: DataFrame, ngram_max: int, norm: str) -> Model:
        """The model that `frame` gave, for example from a file."""
        found = rows.toArrow()
        place, weight = found["place"].to_numpy(), found["weight"].to_numpy()
        w = np.zeros(FEATURES)
        w[place[place >= 0]] = weight[place >= 0]
        return Model(ngram_max, norm, w, float(weight[place < 0].sum()))


def feature_table(rows: DataFrame, ngram_max: int, norm: str) -> DataFrame:
    """(id, label, fold, at, value) of rows (id, text, label, fold), with 0 or 1 as label; rows without text or label are left
    out."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [features(t, ngram_max, norm) for t in batch.column(3).to_pylist()]
            at = pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32()))
            value = pa.array([v for _, v in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], at, value], names=["id", "label", "fold", "at", "value"])

    ship()
    used = rows.where("text is not null and label is not null").select("id", F.col("label").cast("int"), F.col("fold").cast("int"), "text")
    return materialize(spread(used).mapInArrow(run, f"id {kind}, label int, fold int, at array<int>, value array<double>"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at, value = batch.column("at"), batch.column("value")
    places, values = at.flatten().to_numpy(), value.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *at.value_lengths().to_pylist()])
    for i, label in enumerate(batch.column("label").to_pylist()):
        yield (1 if label else -1), places[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]]


def _round(model: Model, alpha: float, decay: float, begun: float):
    """One pass over a task's rows from the model's weights; gives (block, weights, n) with weights times rows, and a last
    row, block -1, with the intercept and the loss."""
    weights, bias0 = model.weights, model.bias
    first = 1.0 / (np.sqrt(1.0 / np.sqrt(alpha)) * alpha)

    def run(batches):
        w, scale, bias, loss, n = weights.copy(), 1.0, bias0, 0.0, 0
        for batch in batches:
            for y, at, value in _rows(batch):
                eta = 1.0 / (alpha * (first + begun + n))
                margin = y * (scale * float(value @ w[at]) + bias)
                loss += max(0.0, 1.0 - margin)
                scale *= max(0.0, 1.0 - decay * eta * alpha)
                if scale < 1e-9:
                    w, scale = w * scale, 1.0
                if margin < 1.0:
                    w[at] += value * (eta * y / scale)
                    bias += eta * y
                n += 1
        if n:
            w *= scale * n
            blocks = [w[i : i + BLOCK] for i in range(0, FEATURES, BLOCK)]
            kept = [i for i, b in enumerate(blocks) if b.any()]
            values = [blocks[i].tobytes() for i in kept] + [np.array([bias * n, loss]).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([*kept, -1], pa.int32()), pa.array(values, pa.binary()), pa.array([n] * len(values), pa.int64())], names=["block", "sums", "n"])

    return run


def _add(table: pa.Table) -> pa.Table:
    """The combiner: sums of vectors, and of the rows that they stand for."""
    total: dict[int, list] = {}
    for block, raw, n in zip(*(table[c].to_pylist() for c in ("block", "sums", "n"))):
        own = np.frombuffer(raw)
        if block in total:
            total[block] = [total[block][0] + own, total[block][1] + n]
        else:
            total[block] = [own, n]
    return pa.table({"block": pa.array(list(total), pa.int32()), "sums": pa.array([s.tobytes() for s, _ in total.values()], pa.binary()), "n": pa.array([n for _, n in total.values()], pa.int64())}, schema=table.schema)


def train(table: DataFrame, ngram_max: int, norm: str, alpha: float, max_iter: int, penalty: str) -> Model:
    """A hinge-loss classifier of a feature table, in at most max_iter rounds.

    A round's weights are the mean of all tasks' by their rows. l2 decays weights at each row, l1 shrinks the mean once a
    round by what the rows of a task would have. Training stops after PATIENCE rounds that lower the mean loss by less than
    TOLERANCE. Without rows all weights are 0.
    """
    l1 = {"l2": 0.0, "l1": 1.0, "elasticnet": L1_RATIO}[penalty]
    model, begun, best, quiet = Model(ngram_max, norm, np.zeros(FEATURES), 0.0), 0.0, np.inf, 0
    tasks = max(table.rdd.getNumPartitions(), 1)
    ship()
    for _ in range(max_iter):
        parts = table.select("label", "at", "value").mapInArrow(_round(model, alpha, 1 - l1, begun), "block int, sums binary, n long")
        found = {r["block"]: (np.frombuffer(r["sums"]), r["n"]) for r in combine(parts, ["block"], _add).collect()}
        if -1 not in found:
            return model
        (bias, loss), n = found[-1]
        w = np.zeros(FEATURES)
        for block, (total, _) in found.items():
            if block >= 0:
                w[block * BLOCK : block * BLOCK + len(total)] = total / n
        steps = begun + np.arange(max(n // tasks, 1))
        shrink = l1 * float((1.0 / (1.0 / (np.sqrt(1.0 / np.sqrt(alpha)) * alpha) + steps)).sum())
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0) if l1 else w
        model.weights, model.bias = w, float(bias / n)
        model.losses.append(float(loss / n))
        begun += n / tasks
        quiet = quiet + 1 if model.losses[-1] > best - TOLERANCE else 0
        best = min(best, model.losses[-1])
        if quiet >= PATIENCE:
            break
    return model


def predict(table: DataFrame, model: Model) -> DataFrame:
    """(id, fold, label, predicted) of a feature table."""
    kind = table.schema["id"].dataType.simpleString()
    shared = table.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        for batch in batches:
            w, bias = shared.value
            found = [int(float(value @ w[at]) + bias > 0) for _, at, value in _rows(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "fold", "label")), pa.array(found, pa.int32())], names=["id", "fold", "label", "predicted"])

    ship()
    return table.mapInArrow(run, f"id {kind}, fold int, label int, predicted int")


def refit(rows: DataFrame, cfg: dict, test_fold: int = 0) -> tuple[Model, DataFrame]:
    """(model, predictions): the classifier with the parameters of `cfg` (of enumerate_grid) trained on all rows (id, text,
    label, fold) outside the test fold, and what it says of every row."""
    table = feature_table(rows, cfg["ngram_max"], cfg["norm"])
    model = train(table.where(F.col("fold") != test_fold), cfg["ngram_max"], cfg["norm"], cfg["alpha"], cfg["max_iter"], cfg["penalty"])
    return model, predict(table, model)
