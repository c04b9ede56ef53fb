import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import gridsearch, training


@pytest.fixture(scope="module")
def reviews(spark):
    """(id, text, label, fold); labels follow from a few words, a tenth of them doesn't."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        label = i % 2
        said = [rng.choice(["good", "fine"] if label else ["bad", "poor"]) for _ in range(3)] + rng.choices(words, k=20)
        rows.append((i, " ".join(rng.sample(said, len(said))), label if rng.random() > 0.1 else 1 - label, i // 2 % 5))
    rows += [(900, None, 1, 1), (901, "no label", None, 1), (902, "", 1, 2)]
    return spark.createDataFrame(rows, "id long, text string, label int, fold int").repartition(6), rows


@pytest.mark.parametrize("penalty", ["l2", "l1", "elasticnet"])
def test_refit_is_right_on_rows_it_has_not_seen(spark, reviews, penalty):
    df, rows = reviews
    model, said = training.refit(df, {"ngram_max": 2, "norm": "l2", "alpha": 1e-3, "max_iter": 15, "penalty": penalty})
    got = said.collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, t, y, _ in rows if t is not None and y is not None)
    test = [r for r in got if r["fold"] == 0]
    assert np.mean([r["label"] == r["predicted"] for r in test]) > 0.8
    # by hand from the model's weights
    text = {i: t for i, t, *_ in rows}
    for r in got[:60]:
        at, value = gridsearch.features(text[r["id"]], 2, "l2")
        assert r["predicted"] == int(value @ model.weights[at] + model.bias > 0)
    assert model.losses[-1] < model.losses[0]
    if penalty == "l1":
        dense, _ = training.refit(df, {"ngram_max": 2, "norm": "l2", "alpha": 1e-3, "max_iter": 15, "penalty": "l2"})
        assert (model.weights != 0).sum() < (dense.weights != 0).sum()


def test_one_task_trains_as_the_search_does(spark, reviews):
    df, rows = reviews
    one = training.feature_table(df.where("id < 60").coalesce(1).orderBy("id").coalesce(1), 1, "l2").coalesce(1)
    model = training.train(one, 1, "l2", 1e-3, 1, "l2")
    held = one.collect()
    w, bias = np.zeros(gridsearch.FEATURES), 0.0
    first = 1 / (np.sqrt(1 / np.sqrt(1e-3)) * 1e-3)
    for n, r in enumerate(held):
        y, eta = (1 if r["label"] else -1), 1 / (1e-3 * (first + n))
        margin = y * (np.dot(r["value"], w[r["at"]]) + bias)
        w *= 1 - eta * 1e-3
        if margin < 1:
            w[r["at"]] += np.array(r["value"]) * eta * y
            bias += eta * y
    assert np.allclose(model.weights, w) and model.bias == pytest.approx(bias)


def test_models_are_kept_and_no_rows_are_fine(spark, reviews, tmp_path):
    df, _ = reviews
    table = training.feature_table(df, 1, "l1")
    model = training.train(table, 1, "l1", 1e-3, 2, "l2")
    model.frame(spark).write.parquet(str(tmp_path / "model"))
    again = training.Model.load(spark.read.parquet(str(tmp_path / "model")), 1, "l1")
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias
    assert sorted(map(tuple, training.predict(table, again).collect())) == sorted(map(tuple, training.predict(table, model).collect()))
    none = training.train(table.where("id < 0"), 1, "l1", 1e-3, 3, "l2")
    assert not none.weights.any() and none.losses == []
    assert training.predict(table.where("id < 0"), none).collect() == []


def test_no_text_comes_to_the_driver(spark, reviews):
    table = training.feature_table(reviews[0], 1, "l2")
    assert "text" not in table.columns
    # a model's blocks are what is collected
    parts = table.select("label", "at", "value").mapInArrow(training._round(training.Model(1, "l2", np.zeros(gridsearch.FEATURES), 0.0), 1e-3, 1.0, 0.0), "block int, sums binary, n long")
    merged = training.combine(parts, ["block"], training._add)
    assert merged.count() <= gridsearch.FEATURES // training.BLOCK + 1
    assert merged.agg(F.max("n")).first()[0] == 601
