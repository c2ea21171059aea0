import random
from datetime import datetime, timedelta

import pytest

from ingestctl.operators import control
from ingestctl.plans.tasks import run_in_open_batch, run_sql_script, run_task
from tests.conftest import rows


def upsert_one_by_one(events):
    """The status table as a sequence of inserts and updates."""
    table = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        key = e["batch_id"], e["job_id"], e["run_id"]
        if key not in table:
            table[key] = {
                **{name: e[name] for name in ["proj_id", "dept_id", "parent_job_id", "workflow_id", "run_url"]},
                "status": e["status"], "start_time": e["ts"], "end_time": None,
                "error_message": e["error_message"] or "",
            }
            continue
        row = table[key]
        row["status"] = e["status"]
        if e["status"] == "IN_PROGRESS":
            row["start_time"] = e["ts"]
        if e["status"] in ("COMPLETED", "FAILED"):
            row["end_time"] = e["ts"]
        if e["error_message"]:
            row["error_message"] = e["error_message"]
    return table


def random_events(n, n_keys, seed, hot=0.0):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    events = []
    for seq in range(n):
        key = 0 if rng.random() < hot else rng.randrange(n_keys)
        status = rng.choice(["IN_PROGRESS", "COMPLETED", "FAILED", "WAITING"])
        events.append({
            "seq": seq, "ts": start + timedelta(seconds=seq), "batch_id": None if key == 1 else key % 3,
            "proj_id": f"p{rng.randrange(3)}", "dept_id": "d", "job_id": f"j{key}", "parent_job_id": None,
            "status": status, "error_message": rng.choice(["", None, f"e{seq}"]) if status == "FAILED" else "",
            "workflow_id": f"w{seq}", "run_id": f"r{key % 2}", "run_url": f"u{seq}",
        })
    return events


@pytest.mark.parametrize("n, n_keys, seed, hot", [(1, 1, 0, 0), (400, 120, 1, 0), (3000, 40, 2, 0.4)])
def test_fold_equals_upserts(spark, n, n_keys, seed, hot):
    events = random_events(n, n_keys, seed, hot)
    shuffled = [tuple(e[name] for name in control.EVENT_SCHEMA.names) for e in events]
    random.Random(9).shuffle(shuffled)
    view = control.status_view(spark.createDataFrame(shuffled, control.EVENT_SCHEMA))
    got = {}
    for row in view.collect():
        row = row.asDict()
        got[row.pop("batch_id"), row.pop("job_id"), row.pop("run_id")] = row
    assert got == upsert_one_by_one(events)


def test_fold_aggregates_in_a_hash_map(spark):
    events = spark.createDataFrame([], control.EVENT_SCHEMA)
    plan = events.groupBy(*control.RUN_KEY).agg({"seq": "max"})
    assert "HashAggregate" in plan._jdf.queryExecution().executedPlan().toString()
    assert control.status_view(events).collect() == []


def test_open_batch(spark):
    batches = spark.createDataFrame([(1, "OPEN"), (5, "Open"), (9, "closed")], "batch_id long, status string")
    assert control.require_open_batch(batches) == 5
    with pytest.raises(control.NoOpenBatch):
        control.require_open_batch(batches.where("batch_id = 9"))


def test_execution_guard(spark):
    status = spark.createDataFrame(
        [(1, "p", "d", "j", "Completed"), (1, "p", "d", "k", "FAILED")],
        "batch_id long, proj_id string, dept_id string, job_id string, status string",
    )
    control.require_not_executed(status, 1, "p", "d", "k")
    control.require_not_executed(status, 2, "p", "d", "j")
    with pytest.raises(control.AlreadyExecuted):
        control.require_not_executed(status, 1, "p", "d", "j")
    jobs = status.drop("status")
    assert rows(control.already_executed(jobs, status)) == [(1, "p", "d", "j")]
    assert rows(control.runnable_jobs(jobs, status)) == [(1, "p", "d", "k")]


def test_parent_of_the_first_parameter_row(spark):
    params = spark.createDataFrame(
        [("p", "d", "j", "late", 2), ("p", "d", "j", "first", 1)],
        "proj_id string, dept_id string, job_id string, parent_job_id string, invocation_id int",
    )
    jobs = spark.createDataFrame([("p", "d", "j"), ("p", "d", "unknown")], "proj_id string, dept_id string, job_id string")
    assert rows(control.parent_jobs(jobs, params)) == [("p", "d", "j", "first"), ("p", "d", "unknown", None)]


def test_task_events(spark, database):
    table = f"{database}.events"
    run = {"batch_id": 4, "run_id": "r"}
    with run_task(spark, table, job_id="good", proj_id="p", **run):
        pass
    with pytest.raises(RuntimeError, match="it's broken"):
        with run_task(spark, table, job_id="bad", **run):
            raise RuntimeError("it's broken")
    status = {row["job_id"]: row for row in control.status_view(spark.table(table)).collect()}
    assert status["good"]["status"] == "COMPLETED" and status["good"]["error_message"] == ""
    assert status["good"]["end_time"] >= status["good"]["start_time"]
    assert status["bad"]["status"] == "FAILED" and status["bad"]["error_message"] == "it's broken"
    assert status["bad"]["proj_id"] is None


def test_run_in_open_batch(spark, database):
    table = f"{database}.events"
    batches = spark.createDataFrame([(3, "open"), (2, "open")], "batch_id long, status string")
    params = spark.createDataFrame(
        [("p", "d", "j", "mother", 1)],
        "proj_id string, dept_id string, job_id string, parent_job_id string, invocation_id int",
    )
    job = {"proj_id": "p", "dept_id": "d", "job_id": "j", "run_id": "r1", "parameters": params}
    with pytest.raises(RuntimeError, match="first try"):
        with run_in_open_batch(spark, batches, table, **job):
            raise RuntimeError("first try")
    with run_in_open_batch(spark, batches, table, **{**job, "run_id": "r2"}) as batch_id:
        assert batch_id == 3
    with pytest.raises(control.AlreadyExecuted):
        with run_in_open_batch(spark, batches, table, **job):
            raise AssertionError("must not run")
    with pytest.raises(control.NoOpenBatch):
        with run_in_open_batch(spark, batches.where("batch_id > 9"), table, **job):
            raise AssertionError("must not run")
    status = control.status_view(spark.table(table)).select("run_id", "status", "parent_job_id")
    assert rows(status) == [("r1", "FAILED", "mother"), ("r2", "COMPLETED", "mother")]


def test_sql_script_is_run_and_written(spark, database):
    counts = run_sql_script(spark, 'SELECT "it is \'text\'" AS m, :n AS n', {"n": 3}, f"{database}.out")
    assert counts.written == 1
    assert rows(spark.table(f"{database}.out")) == [("it is 'text'", 3)]


def test_compacted_events_give_the_same_status(spark):
    events = []
    for run in range(4):
        for seq in range(30):
            status = ["IN_PROGRESS", "COMPLETED", "FAILED", "PAUSED"][(seq * 7 + run) % 4]
            row = (seq, datetime(2024, 1, 1, 0, seq), 1, "p", "d", "j", None, status, "e" * (seq % 3), f"w{seq}", f"r{run}", "u")
            events.append(row)
    frame = spark.createDataFrame(events, control.EVENT_SCHEMA)
    compacted = control.compact_events(frame)
    assert compacted.count() <= 20
    assert rows(control.status_view(compacted)) == rows(control.status_view(frame))


def test_events_are_partitioned_by_batch(spark, database):
    for batch in (1, 2):
        control.record_event(spark, f"{database}.ev", batch_id=batch, job_id="j", run_id="r", status="IN_PROGRESS")
    assert spark.sql(f"SHOW PARTITIONS {database}.ev").count() == 2


def test_events_at_one_number_have_an_order(spark):
    """By time, then a start before an end; the same however the rows are dealt, and after compaction."""
    at = datetime(2024, 1, 1)

    def event(run, seq, second, status, message="", workflow="w"):
        return (seq, at + timedelta(seconds=second), 1, "p", "d", "j", None, status, message, workflow, run, "u")

    events = [
        event("a", 5, 0, "IN_PROGRESS"), event("a", 5, 3, "COMPLETED"),
        event("b", 5, 1, "COMPLETED"), event("b", 5, 1, "IN_PROGRESS"),
        event("c", 5, 2, "FAILED", "e1"), event("c", 5, 1, "IN_PROGRESS", workflow="v"), event("c", 5, 2, "FAILED", "e2"),
        event("d", 5, 0, "COMPLETED"), event("d", 5, 0, "COMPLETED"),
    ]
    expected = [
        ("a", "COMPLETED", at, at + timedelta(seconds=3), "", "w"),
        ("b", "COMPLETED", at + timedelta(seconds=1), at + timedelta(seconds=1), "", "w"),
        ("c", "FAILED", at + timedelta(seconds=1), at + timedelta(seconds=2), "e2", "v"),
        ("d", "COMPLETED", at, None, "", "w"),
    ]
    for seed in range(3):
        random.Random(seed).shuffle(events)
        frame = spark.createDataFrame(events, control.EVENT_SCHEMA).repartition(3)
        for one in (frame, control.compact_events(frame)):
            view = control.status_view(one)
            got = view.select("run_id", "status", "start_time", "end_time", "error_message", "workflow_id").orderBy("run_id")
            assert [tuple(r) for r in got.collect()] == expected


def test_a_clock_that_is_behind_cannot_reopen_a_run(spark, database, monkeypatch):
    table = f"{database}.skewed_events"
    clock = iter([5_000, 4_000, 3_000, 9_000, 1_000])
    monkeypatch.setattr(control.time, "time_ns", lambda: next(clock))
    for run, status in (("r", "IN_PROGRESS"), ("r", "COMPLETED"), ("other", "IN_PROGRESS"), ("r", "IN_PROGRESS"), ("r", "FAILED")):
        control.record_event(spark, table, batch_id=1, job_id="j", run_id=run, status=status)
    held = spark.table(table).orderBy("seq").select("run_id", "seq", "status").collect()
    assert [tuple(r) for r in held] == [
        ("other", 3_000, "IN_PROGRESS"), ("r", 5_000, "IN_PROGRESS"), ("r", 5_001, "COMPLETED"), ("r", 9_000, "IN_PROGRESS"),
        ("r", 9_001, "FAILED"),
    ]
    status = {r["run_id"]: r["status"] for r in control.status_view(spark.table(table)).collect()}
    assert status == {"r": "FAILED", "other": "IN_PROGRESS"}
