"""Batches, job status and execution guards.

Status is an append-only table of events; the current status of a run is a fold over them.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestctl.scratch import materialise, small_frame
from ingestctl.sources.tables import partition_columns, table_exists

RUN_KEY = ["batch_id", "job_id", "run_id"]
JOB_KEY = ["batch_id", "proj_id", "dept_id", "job_id"]

# Status names.
IN_PROGRESS, COMPLETED, FAILED = "IN_PROGRESS", "COMPLETED", "FAILED"

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("batch_id", T.LongType()),
        T.StructField("proj_id", T.StringType()),
        T.StructField("dept_id", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("parent_job_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("workflow_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("run_url", T.StringType()),
    ]
)

_ENDED = f"status IN ('{COMPLETED}', '{FAILED}')"
_FIRST_WRITTEN = ["proj_id", "dept_id", "parent_job_id", "workflow_id", "run_url"]


class NoOpenBatch(RuntimeError):
    pass


class AlreadyExecuted(RuntimeError):
    pass


def open_batch(batches: DataFrame) -> DataFrame:
    """One row: the largest batch id with status open in any case, NULL if none is."""
    return batches.where(F.lower("status") == "open").agg(F.max("batch_id").alias("batch_id"))


def require_open_batch(batches: DataFrame) -> int:
    batch_id = open_batch(batches).first()["batch_id"]
    if batch_id is None:
        raise NoOpenBatch("there is no open batch; open one first")
    return batch_id


def event_order() -> Column:
    """Where an event stands among those of its run: by ``seq``, then time, then status, a start before an end.

    Events that still tie are alike in all that the fold reads.
    """
    rank = F.when(F.col("status") == IN_PROGRESS, 0).when(F.col("status") == FAILED, 1).when(F.col("status") == COMPLETED, 2)
    return F.struct("seq", "ts", F.coalesce(rank, F.lit(3)).alias("rank"), "status", "error_message", *_FIRST_WRITTEN)


def _deciding_seqs(events: DataFrame) -> DataFrame:
    """(RUN_KEY, wanted_seq): at most five sequence numbers of each run, at which the events lie that its status depends on.

    They are of the first, the last, and the last that had an error message, ended the run, or
    started it. Numbers alone are folded: such aggregates stay in a hash map and combine before
    the shuffle, so a long run costs no task more than any other.
    """
    counting = [
        F.min("seq").alias("opened"),
        F.max("seq").alias("latest"),
        F.expr("max(seq) FILTER (WHERE error_message <> '')").alias("failing"),
        F.expr(f"max(seq) FILTER (WHERE {_ENDED})").alias("ending"),
        F.expr(f"max(seq) FILTER (WHERE status = '{IN_PROGRESS}')").alias("starting"),
    ]
    names = ["opened", "latest", "failing", "ending", "starting"]
    wanted = F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("wanted_seq")
    return materialise(events.groupBy(*RUN_KEY).agg(*counting).select(*RUN_KEY, wanted), "deciding")


def compact_events(events: DataFrame) -> DataFrame:
    """The events that the current status depends on: those at the first and last sequence numbers of each run, and at
    the last that had an error message, ended the run, or started it; of events at one number, all.

    ``status_view`` gives the same for these as for all. Each event is a small file of its own
    until the table is rewritten as this frame.
    """
    wanted = _deciding_seqs(events).toDF(*[f"run_{i}" for i in range(len(RUN_KEY))], "wanted_seq")
    same = events["seq"] == wanted["wanted_seq"]
    for i, key in enumerate(RUN_KEY):
        same = same & events[key].eqNullSafe(wanted[f"run_{i}"])
    return events.join(wanted, same, "left_semi")


def status_view(events: DataFrame) -> DataFrame:
    """Current status per (batch_id, job_id, run_id) from events in their order (``event_order``).

    The first event opens the run: it gives the start time, whatever its status, and the
    descriptive columns. Each later event sets the status; IN_PROGRESS sets the start time,
    COMPLETED and FAILED the end time; a non-empty error message replaces the former one.

    The few events that count are found by number first and looked up by run and ``seq``; the
    numbers have been written, so their true size decides whether they are broadcast, and with
    ``seq`` in the key a shuffle of a long run's events spreads them evenly.
    """
    ordered = compact_events(events).withColumn("event_order", event_order())
    told = ordered.groupBy(*RUN_KEY).agg(
        F.max_by("status", "event_order").alias("status"),
        F.expr("max_by(error_message, event_order) FILTER (WHERE error_message <> '')").alias("error_message"),
        F.expr(f"max_by(ts, event_order) FILTER (WHERE status = '{IN_PROGRESS}')").alias("restarted"),
        F.min("event_order").alias("first"),
        F.expr(f"max(event_order) FILTER (WHERE {_ENDED})").alias("ended"),
    )
    return told.select(
        *RUN_KEY,
        *[F.col("first")[name].alias(name) for name in _FIRST_WRITTEN],
        "status",
        F.coalesce("restarted", F.col("first")["ts"]).alias("start_time"),
        F.when(F.col("ended") > F.col("first"), F.col("ended")["ts"]).alias("end_time"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


def completed_jobs(status: DataFrame) -> DataFrame:
    return status.where(F.lower("status") == "completed").select(*JOB_KEY).distinct()


def already_executed(jobs: DataFrame, status: DataFrame) -> DataFrame:
    """Jobs with a completed run in their batch."""
    return jobs.join(completed_jobs(status), JOB_KEY, "left_semi")


def runnable_jobs(jobs: DataFrame, status: DataFrame) -> DataFrame:
    """Jobs without a completed run in their batch."""
    return jobs.join(completed_jobs(status), JOB_KEY, "left_anti")


def require_not_executed(
    status: DataFrame, batch_id: int, proj_id: str, dept_id: str, job_id: str
) -> None:
    mine = (
        (F.col("batch_id") == batch_id)
        & (F.col("proj_id") == proj_id)
        & (F.col("dept_id") == dept_id)
        & (F.col("job_id") == job_id)
    )
    if not completed_jobs(status).where(mine).isEmpty():
        raise AlreadyExecuted(f"job {job_id} has already been completed in batch {batch_id}")


def parent_jobs(jobs: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each job with the parent of its first parameter row, NULL where it has none."""
    key = ["proj_id", "dept_id", "job_id"]
    wanted = parameters.join(jobs.select(*key).distinct(), key, "left_semi")
    first = wanted.groupBy(*key).agg(
        F.min_by("parent_job_id", F.struct("invocation_id", "parent_job_id")).alias("parent_job_id")
    )
    return jobs.join(materialise(first, "parents"), key, "left")


def _last_seq(events: DataFrame, batch_id: int, job_id: str, run_id: str) -> int | None:
    """The largest ``seq`` of a run; reads the files of its batch alone where the table is partitioned by batch."""
    mine = events.where(F.col("batch_id").eqNullSafe(F.lit(batch_id)))
    mine = mine.where(F.col("job_id").eqNullSafe(F.lit(job_id)) & F.col("run_id").eqNullSafe(F.lit(run_id)))
    return mine.agg(F.max("seq").alias("last")).first()["last"]


def record_event(
    spark: SparkSession,
    table: str,
    *,
    batch_id: int,
    job_id: str,
    run_id: str,
    status: str,
    proj_id: str | None = None,
    dept_id: str | None = None,
    parent_job_id: str | None = None,
    error_message: str = "",
    workflow_id: str | None = None,
    run_url: str | None = None,
    seq: int | None = None,
    ts: datetime | None = None,
) -> None:
    """Append one status event; ``ts`` defaults to the clock, ``seq`` to the clock or, if the run has a later
    event already, to one more than that event's.

    So a clock that is behind, or is turned back, cannot put an event before those it followed.
    """
    known = table_exists(spark, table)
    if seq is None:
        last = _last_seq(spark.table(table), batch_id, job_id, run_id) if known else None
        seq = max(time.time_ns(), 0 if last is None else last + 1)
    row = (
        seq,
        ts or datetime.now(timezone.utc),
        batch_id,
        proj_id,
        dept_id,
        job_id,
        parent_job_id,
        status,
        error_message,
        workflow_id,
        run_id,
        run_url,
    )
    writer = small_frame(spark, [row], EVENT_SCHEMA).write.mode("append")
    columns = partition_columns(spark, table) if known else ["batch_id"]
    (writer.partitionBy(*columns) if columns else writer).saveAsTable(table)
