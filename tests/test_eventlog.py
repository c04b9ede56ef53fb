import json
import time

import pytest
from pyspark.sql import functions as F

from weft.operators import trace
from weft.sources import eventlog


def entry(stage, part, launch, finish, run=0, wait=0, write=0, reason="Success", attempt=0, records=0):
    metrics = {"Executor Run Time": run, "Shuffle Read Metrics": {"Fetch Wait Time": wait}, "Shuffle Write Metrics": {"Shuffle Write Time": write * 1_000_000}, "Input Metrics": {"Records Read": records}}
    info = {"Task ID": 1, "Index": part, "Attempt": attempt, "Launch Time": launch, "Executor ID": "1", "Finish Time": finish}
    return {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": 0, "Task End Reason": {"Reason": reason}, "Task Info": info, "Task Metrics": metrics}


def test_marks_of_a_written_log(spark, tmp_path):
    lost = entry(1, 1, 300, 350, reason="ExecutorLostFailure") | {"Task Metrics": None}
    rows = [{"Event": "SparkListenerLogStart"}, entry(0, 0, 100, 200, 80, 10, 5, records=7), entry(1, 0, 210, 300, 60), entry(1, 1, 350, 420, 90, 5), lost]
    (tmp_path / "log").write_text("\n".join(map(json.dumps, rows)) + '\n{"Event": "SparkListenerTaskEnd", "Sta')
    tasks = eventlog.read_tasks(spark, str(tmp_path / "log"))
    assert tasks.count() == 4 and tasks.where("not succeeded").first()["run_ms"] == 0
    marks = trace.parse_trace(eventlog.task_trace(tasks))
    durations = {(r["worker"], r["trial"], r["phase"]): r["ms"] for r in trace.phase_durations(marks).collect()}
    assert durations == {
        (0, 0, "compute"): 65, (0, 0, "alltoall"): 15, (0, 0, "process"): 20,
        (0, 1, "compute"): 60, (0, 1, "alltoall"): 0, (0, 1, "process"): 30,
        (1, 1, "compute"): 70, (1, 1, "alltoall"): 0, (1, 1, "process"): 0,
    }
    assert trace.makespan(marks).first()["ms"] == 320
    assert {(r["worker"], r["trial"]): r["ms"] for r in trace.trial_times(marks).collect()} == {(0, 0): 100, (0, 1): 90, (1, 1): 70}
    summary = {r["stage"]: r for r in eventlog.stage_summary(tasks).collect()}
    assert (summary[0]["n_tasks"], summary[0]["records_read"]) == (1, 7)
    assert (summary[1]["n_tasks"], summary[1]["n_failed"], summary[1]["ms"]) == (2, 1, 210) and summary[1]["skew"] == pytest.approx(90 / 80)


def test_log_of_a_run(spark, tmp_path):
    spark.range(10_000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    began = time.time() * 1000
    with eventlog.recorded(spark) as log:
        assert len(rows.groupBy((F.col("id") % 7).alias("k")).count().collect()) == 7
    ended = time.time() * 1000
    # what follows isn't in the log
    rows.count()
    tasks = eventlog.read_tasks(spark, log)
    assert tasks.agg(F.sum("records_read")).first()[0] == 10_000
    times = tasks.agg(F.min("launch"), F.max("finish")).first()
    assert began - 1 <= times[0] <= times[1] <= ended + 1
    assert eventlog.stage_summary(tasks).where("shuffle_written > 0").count() == 1


def test_failing_run_is_logged_too(spark):
    with pytest.raises(Exception, match="no such thing"):
        with eventlog.recorded(spark) as log:
            spark.range(0, 1, 1, 1).select(F.raise_error(F.lit("no such thing"))).collect()
    tasks = eventlog.read_tasks(spark, log)
    assert tasks.where("not succeeded").count() >= 1 and trace.makespan(trace.parse_trace(eventlog.task_trace(tasks))).first()["ms"] is None
