import bz2
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import collectives, gridsearch, kmeans, trace
from weft.plans import catalogue, formats
from weft.sources import tables


def test_kmeans_on_a_line(spark):
    points = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, 2, 10, 11, 12])] + [(9, None)], "id long, x array<float>")
    first = np.array([[0.0], [1.0], [100.0]])
    assert {r["id"]: r["cluster"] for r in kmeans.assign(points, first, "id", "x").collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
    rows = {r["cluster"]: (r["n"], r["centroid"]) for r in kmeans.step(points, first, "x").collect()}
    # a cluster without points goes to the origin
    assert rows == {0: (1, [0.0]), 1: (5, [pytest.approx(7.2)]), 2: (0, [0.0])}
    assert sorted(kmeans.fit(points, first[:2], "x", 5).ravel()) == pytest.approx([1, 11])
    assert sorted(kmeans.fit(points, first[:2], "x", 50, threshold=0.0).ravel()) == pytest.approx([1, 11])
    change = kmeans.membership_change(points, first[:2], np.array([[1.0], [11.0]]), "id", "x").first()
    assert (change["n"], change["moved"]) == (6, 2)
    assert (kmeans.first_points(points, "id", "x", 2) == [[0], [1]]).all()
    with pytest.raises(ValueError):
        kmeans.assign(points, np.zeros((0, 1)), "id", "x")


@pytest.fixture
def thin_points(spark, monkeypatch):
    """Six points in 32 partitions, so most tasks have none; for the registered queries by way of `table`."""
    points = spark.createDataFrame([(i, [float(x)] * 64) for i, x in enumerate([0, 1, 2, 10, 11, 12])], "vec_id long, embedding array<float>").repartition(32, "vec_id")
    for module in (catalogue, formats):
        monkeypatch.setattr(module, "table", lambda spark, sf_dir, name: points)
    return points


def test_a_step_over_tasks_without_points(spark, thin_points):
    rows = {(r["cluster"], r["j"]): (r["n"], r["value"]) for r in catalogue.kmeans_step(spark, "").collect()}
    assert rows == {(c, j): x for c, x in enumerate([(1, 0.0), (1, 1.0), (4, 8.75)]) for j in range(64)}
    # without any point all clusters go to the origin
    none = kmeans.step(thin_points.where("vec_id < 0"), np.ones((2, 64)), "embedding").collect()
    assert [(r["n"], set(r["centroid"])) for r in none] == [(0, {0.0})] * 2


def test_change_of_clusters_over_tasks_without_points(spark, thin_points):
    # first centroids 0, 1, 2; after a step 0, 1, 8.75: the point at 2 goes from the last cluster to the second
    assert tuple(catalogue.kmeans_delta(spark, "").first()) == (6, 1, pytest.approx(1 / 6))


def test_an_empty_cluster_over_tasks_without_points(spark, thin_points):
    found = {(r["cluster"], r["value"]) for r in formats.kmeans_empty_cluster(spark, "").collect()}
    assert found == {(0, 0.0), (1, 1.0), (2, 8.75), (3, 0.0)}


def test_three_steps_over_tasks_without_points(spark, thin_points):
    # means of 0 | 1 | 2 10 11 12, then of 0 | 1 2 | 10 11 12, which stays
    assert {(r["cluster"], r["value"]) for r in catalogue.kmeans_fit_k(spark, "").collect()} == {(0, 0.0), (1, 1.5), (2, 11.0)}


def test_a_random_start_over_tasks_without_points(spark, thin_points):
    assert tuple(formats.kmeans_random_start(spark, "").first()) == (5, 320, 320, 6)


def test_ties_go_to_the_first_cluster(spark):
    points = spark.createDataFrame([(0, [1.0, 1.0])], "id long, x array<float>")
    assert kmeans.assign(points, np.array([[0.0, 1.0], [2.0, 1.0]]), "id", "x").first()["cluster"] == 0


def test_points_and_reviews(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1.5, 2\n3,x,4\n")
    assert [r["features"] for r in tables.read_points(spark, str(tmp_path / "p.csv")).collect()] == [[1.5, 2.0], [3.0, 4.0]]
    with bz2.open(tmp_path / "r.bz2", "wt") as f:
        f.write("__label__2 good stuff\n__label__1 bad\n\n")
    assert [tuple(r) for r in tables.read_reviews(spark, str(tmp_path / "r.bz2")).collect()] == [(1, "good stuff"), (0, "bad")]
    texts = spark.createDataFrame([(i, "x" * 2**18) for i in range(9)], "id long, t string")
    assert sorted(r["id"] for r in tables.take_mebibytes(texts, "id", "t", 1.0).collect()) == [0, 1, 2, 3, 4]


def test_collectives(spark):
    rows = spark.createDataFrame([(s, s * 10 + i, "ab") for s in range(4) for i in range(3)], "sender long, v long, body string")
    size = F.length("body")
    counts = lambda df: {(r["sender"], r["receiver"]): (r["n"], r["bytes"]) for r in collectives.traffic(df, size).collect()}
    assert counts(collectives.all_to_all(rows, F.col("v") % 4, 4))[1, 2] == (1, 2)
    assert counts(collectives.broadcast(rows, 4)) == {(0, r): (3, 6) for r in range(4)}
    assert counts(collectives.gather(rows)) == {(s, 0): (3, 6) for s in range(4)}
    assert counts(collectives.scatter(rows, F.col("v"), 4)) == {(0, r): (1, 2) for r in range(3)}
    assert counts(collectives.pair(rows, 4)) == {(2, 0): (3, 6), (3, 1): (3, 6)}
    with pytest.raises(ValueError):
        collectives.pair(rows, 3)
    parted = collectives.all_to_all(rows, F.col("v") % 4, 4).withColumn("p", F.spark_partition_id()).groupBy("receiver").agg(F.countDistinct("p").alias("n"))
    assert {r["n"] for r in parted.collect()} == {1}
    nodes, work = collectives.union_ids(rows.withColumn("w", F.col("v") > 30), "sender", "w")
    assert nodes.count() == 4 and work.first()["has_work"]
    assert collectives.concat_ordered(rows.withColumn("body", F.col("v").cast("string")), "sender", "v", "body").where("sender = 1").first()["body"] == "101112"
    by_worker = collectives.throughput(rows.withColumn("t", F.col("v") * 1000), size * 1048576, F.col("t"), F.col("t"))
    assert by_worker.where("worker = 0").first()["mib_per_s"] == pytest.approx(3.0)
    assert collectives.total_throughput(by_worker).first()["mib_per_s"] == pytest.approx(12.0)
    assert {r["receiver"] for r in collectives.halves(rows, 20, "v").collect()} == {0, 1}
    assert collectives.reduce_rows(rows, "sender", "v").where("sender = 2").first()["v"] == 63


def test_traces(spark):
    marks = {"worker_start": 0, "graph_generated": 7, "trial_0_start": 10, "trial_0_iter_0_compute": 15, "trial_0_iter_0_alltoall": 17, "trial_0_iter_0_process": 20, "trial_0_iter_1_compute": 28, "trial_0_iter_1_alltoall": 29, "trial_0_end": 40, "worker_end": 50, "odd": 1}
    rows = spark.createDataFrame([(w, [(k, str(v + w * 100)) for k, v in marks.items()]) for w in (0, 1)] + [(2, [("bad", "x")])], "worker long, timestamps array<struct<key:string,value:string>>")
    events = trace.parse_trace(rows)
    found = {(r["iter"], r["phase"]): r["ms"] for r in trace.phase_durations(events).where("worker = 1").collect()}
    assert found == {(0, "compute"): 5, (0, "alltoall"): 2, (0, "process"): 3, (1, "compute"): 8, (1, "alltoall"): 1}
    assert tuple(trace.mean_phase(trace.phase_durations(events)).first()) == (6.5, 1.5)
    assert tuple(trace.mean_phase(trace.phase_durations(events.where("false"))).first()) == (0.0, 0.0)
    assert trace.makespan(events).first()["ms"] == 150
    assert {r["ms"] for r in trace.trial_times(events).collect()} == {30}
    assert {r["worker"]: r["ms"] for r in trace.load_times(events).collect()} == {0: 7, 1: 7, 2: 0}


def test_result_frames(spark):
    a, b = spark.createDataFrame([(1, 2)], "fn int, x int"), spark.createDataFrame([(2, 3)], "fn int, y int")
    merged = trace.merge_stats([a, b])
    assert [tuple(r) for r in merged.orderBy("fn").collect()] == [(1, 2, None), (2, None, 3)]
    assert trace.update_stats(merged, spark.createDataFrame([(1, 9)], "fn int, z int"), "fn").orderBy("fn").first()["z"] == 9
    results = spark.createDataFrame([([(1, 5)],), (None,)], "results array<struct<fn:int,t:int>>")
    assert [tuple(r) for r in trace.flatten_results(results).collect()] == [(1, 5)]
    jobs = spark.createDataFrame([(0, 100, 110, 130), (1, 90, 95, 99)], "fn int, submit long, start long, end long")
    assert [tuple(r) for r in trace.gantt(jobs).collect()] == [(1, 5, 4), (0, 20, 20)]


def test_grid_search(spark):
    assert gridsearch.enumerate_grid(spark).count() == 192
    rows = spark.createDataFrame([(i, "good fine nice day" if i % 3 else "bad awful poor night", int(bool(i % 3))) for i in range(60)], "id long, text string, label int")
    folds = gridsearch.assign_folds(rows, "id", "label")
    assert {(r["label"], r["fold"]): r["count"] for r in folds.groupBy("label", "fold").count().collect()} == {(y, f): 4 if y == 0 else 8 for y in (0, 1) for f in range(5)}
    grid = {"norm": ["l2", "l1"], "ngram_max": [2], "alpha": [1e-3], "max_iter": [5], "penalty": ["l2", "l1", "elasticnet"]}
    scores = gridsearch.grid_search(rows, grid)
    assert scores.count() == 30
    best = gridsearch.best_configuration(scores, gridsearch.enumerate_grid(spark, grid)).first()
    assert best["mean_score"] == 1.0
    assert gridsearch.sliced_search(rows, 2, grid | {"norm": ["l2"], "penalty": ["l2"]}).count() == 2
    assert gridsearch.ngrams("A big, big Dog!", 2) == ["big", "big", "dog", "big big", "big dog"]
    with pytest.raises(ValueError):
        gridsearch.grid_search(rows, grid, mib=1e6)


def test_each_fold_of_a_slice_is_a_task(spark):
    rng = np.random.default_rng(5)
    words = ["good", "fine", "day", "bad", "poor", "night"]
    docs = [(i, " ".join(words[k] for k in rng.integers(0, 4, 6) + 2 * (i % 3 == 0)), int(i % 3 > 0)) for i in range(61)]
    grid = {"norm": ["l2", "l1"], "ngram_max": [1], "alpha": [1e-2, 1e-4], "max_iter": [2, 9], "penalty": ["l2", "elasticnet"]}
    search = gridsearch.sliced_search(spark.createDataFrame(docs, "id long, text string, label int"), 2, grid)
    # ten partitions that adaptive execution doesn't join again
    assert re.search(r"Exchange shufflepartitionidpassthrough.*, 10\), REPARTITION_BY_NUM", search._jdf.queryExecution().executedPlan().toString())
    cfgs = [r.asDict() for r in gridsearch.enumerate_grid(spark, grid).collect()]
    want = {}
    for worker in range(2):
        mine, seen, data = [d for d in docs if d[0] % 2 == worker], {}, []
        for _, text, label in mine:
            data.append((text, label, seen.setdefault(label, 0) % 5))
            seen[label] += 1
        for c in cfgs:
            rows = [gridsearch.features(t, 1, c["norm"]) for t, _, _ in data]
            want[worker, c["cfg_id"]] = np.mean([gridsearch._fit_and_score(data, rows, [c], f)[0] for f in range(5)])
    assert {(r["worker"], r["cfg_id"]): r["score"] for r in search.collect()} == pytest.approx(want)


def test_models_that_stop_leave_the_others_as_they_are():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 50, 8)), None) for _ in range(60)]
    rows = [(at, np.full(len(at), 0.3)) for at, _ in rows]
    y = rng.choice([-1, 1], 60)
    models = [(a, p) for a in (0.5, 1e-3, 1e-5) for p in gridsearch.GRID["penalty"]]
    together, order = {}, []
    gridsearch.train_together(rows, y, models, [3, 60], lambda k, n, w, b: (together.update({(k, n): (w, b)}), order.append(k)))
    # some stop long before the others
    assert set(together) == {(k, n) for k in range(len(models)) for n in (3, 60)} and order[len(models) :] != sorted(order[len(models) :])
    for k, (alpha, penalty) in enumerate(models):
        for n, (w, b) in gridsearch.train_sgd_path(rows, y, alpha, [3, 60], penalty).items():
            assert np.allclose(together[k, n][0], w) and together[k, n][1] == pytest.approx(b)


def test_one_run_serves_all_numbers_of_epochs():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 50, 8)), None) for _ in range(60)]
    rows = [(at, np.full(len(at), 0.3)) for at, _ in rows]
    y = rng.choice([-1, 1], 60)
    for penalty in gridsearch.GRID["penalty"]:
        path = gridsearch.train_sgd_path(rows, y, 1e-3, [1, 3, 40], penalty)
        for n, (w, b) in path.items():
            alone, bias = gridsearch.train_sgd(rows, y, 1e-3, n, penalty)
            assert (w == alone).all() and b == bias


def test_registered_searches_cover_the_whole_grid(spark, monkeypatch):
    # as small as a table gets with both classes in each fold; the grid is what counts here
    docs = spark.createDataFrame([(i, "good fine day" if i % 2 else "bad poor night") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(catalogue, "table", lambda spark, sf_dir, name: {"documents": docs, "labels": labels}[name])
    scores = catalogue.grid_search_cv(spark, "")
    assert {(r["cfg_id"], r["fold"]) for r in scores.collect()} == {(c, f) for c in range(192) for f in range(5)}
    assert catalogue.grid_search_slices(spark, "").select("cfg_id").distinct().count() == 192
