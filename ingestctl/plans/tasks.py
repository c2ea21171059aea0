"""Running a piece of work with status events around it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestctl.operators.control import (
    COMPLETED,
    FAILED,
    IN_PROGRESS,
    parent_jobs,
    record_event,
    require_not_executed,
    require_open_batch,
    status_view,
)
from ingestctl.operators.sinks import WriteCounts, write_table
from ingestctl.sources.tables import table_exists


@contextmanager
def run_task(spark: SparkSession, events_table: str, **run: Any):
    """Record IN_PROGRESS, then COMPLETED, or FAILED with the message before the error goes on.

    ``run`` are the keyword arguments of ``record_event`` that identify the run.
    """
    record_event(spark, events_table, status=IN_PROGRESS, **run)
    try:
        yield
    except Exception as error:
        record_event(spark, events_table, status=FAILED, error_message=str(error), **run)
        raise
    record_event(spark, events_table, status=COMPLETED, **run)


def run_sql_script(
    spark: SparkSession, text: str, parameters: dict[str, Any], target_table: str, mode: str = "overwrite"
) -> WriteCounts:
    """Run a stored query text with bound parameters and write its rows."""
    return write_table(spark.sql(text, args=parameters), target_table, mode)


def run_all(
    spark: SparkSession,
    events_table: str,
    tasks: dict[str, Callable[[], Any]],
    **run: Any,
) -> list[str]:
    """Run independent tasks by job id, each with its own events; returns those that failed."""
    failed = []
    for job_id, work in tasks.items():
        try:
            with run_task(spark, events_table, job_id=job_id, **run):
                work()
        except Exception:
            failed.append(job_id)
    return failed


@contextmanager
def run_in_open_batch(
    spark: SparkSession,
    batches: DataFrame,
    events_table: str,
    *,
    proj_id: str,
    dept_id: str,
    job_id: str,
    parameters: DataFrame | None = None,
    **run: Any,
):
    """``run_task`` in the open batch, whose id it yields.

    Raises ``NoOpenBatch`` without one, and ``AlreadyExecuted`` if the job has a completed run
    in it. The parent job comes from the parameter table where that is given.
    """
    batch_id = require_open_batch(batches)
    if table_exists(spark, events_table):
        # batch and job are part of a run's key, so the fold needs no other events
        mine = spark.table(events_table).where((F.col("batch_id") == batch_id) & (F.col("job_id") == job_id))
        require_not_executed(status_view(mine), batch_id, proj_id, dept_id, job_id)
    parent_job_id = None
    if parameters is not None:
        schema = "proj_id string, dept_id string, job_id string"
        wanted = spark.createDataFrame([(proj_id, dept_id, job_id)], schema)
        parent_job_id = parent_jobs(wanted, parameters).first()["parent_job_id"]
    with run_task(
        spark, events_table, batch_id=batch_id, proj_id=proj_id, dept_id=dept_id, job_id=job_id,
        parent_job_id=parent_job_id, **run,
    ):
        yield batch_id
