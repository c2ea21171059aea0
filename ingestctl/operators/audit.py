"""Audit rows, and the ledger of files that were loaded."""

from __future__ import annotations

from datetime import datetime, timezone
from threading import Lock

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestctl.operators.sinks import WriteCounts
from ingestctl.scratch import small_frame
from ingestctl.sources.tables import partition_columns, table_exists
from ingestctl.spec import IngestSpec

_one_append_at_a_time = Lock()

# The columns of the audit table.
AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("processed_timestamp", T.TimestampType(), False),
        T.StructField("entity_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("file_names", T.ArrayType(T.StringType())),
        T.StructField("file_pattern", T.StringType()),
        T.StructField("previous_row_count_in_table", T.LongType()),
        T.StructField("new_row_count_in_table", T.LongType()),
        T.StructField("file_row_count", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("workflow_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)

# A file counts as loaded only in the version that was read: a new delivery under an old name is new.
LEDGER_KEY = ["file_path", "version", "length"]

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("processed_timestamp", T.TimestampType()),
        T.StructField("load_id", T.StringType()),
        T.StructField("load_finished", T.BooleanType()),
    ]
)


def audit_row(
    spark: SparkSession,
    spec: IngestSpec,
    run: dict[str, str | None],
    file_names: list[str],
    counts: WriteCounts | None,
    error_message: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """One audit row: SUCCESS with counts, or FAILURE with the message and no counts.

    ``file_names`` are those of one load step, whose number the caller bounds.
    """
    row = (
        now or datetime.now(timezone.utc),
        spec.entity_name,
        spec.target_table.replace("`", ""),
        file_names,
        spec.file_pattern,
        counts.before if counts else None,
        counts.after if counts else None,
        counts.written if counts else None,
        "SUCCESS" if counts else "FAILURE",
        error_message,
        spec.source_path,
        run.get("job_id"),
        run.get("workflow_id"),
        run.get("run_id"),
    )
    return small_frame(spark, [row], AUDIT_SCHEMA)


def ledger_rows(
    spark: SparkSession,
    table: str,
    files: list[Row],
    run_id: str | None,
    now: datetime | None = None,
    load_id: str | None = None,
    load_finished: bool = True,
) -> DataFrame:
    """One row per loaded file of one load step; without files one row without a file, as a mark."""
    stamp = now or datetime.now(timezone.utc)
    listed = [(f["file_path"], f["file_name"], f["length"], f["version"]) for f in files]
    rows = [
        (table, *file, run_id, stamp, load_id, load_finished) for file in listed or [(None, None, None, None)]
    ]
    return small_frame(spark, rows, LEDGER_SCHEMA)


def record_once(spark: SparkSession, table: str, ledger_table: str, load_id: str, listed: list[dict], **row) -> None:
    """Ledger rows of one load step of ``table``, unless they are there; ``listed`` are its files as dictionaries."""
    files = [Row(**file) for file in listed]
    if table_exists(spark, ledger_table):
        held = spark.table(ledger_table).where((F.col("load_id") == load_id) & (F.col("table_name") == table))
        paths = {r["file_path"] for r in held.select("file_path").collect()}
        files = [file for file in files if file["file_path"] not in paths]
    if files:
        append_ledger(ledger_rows(spark, table, files, load_id=load_id, **row), ledger_table)


def load_is_unfinished(spark: SparkSession, ledger_table: str, table: str) -> bool:
    """Whether the last load of a table wrote some of its steps and not the last one."""
    if not table_exists(spark, ledger_table):
        return False
    last = (
        spark.table(ledger_table)
        .where((F.col("table_name") == table) & F.col("load_id").isNotNull())
        .groupBy("load_id")
        .agg(F.max("processed_timestamp").alias("at"), F.max("load_finished").alias("finished"))
        .agg(F.max(F.struct("at", "finished")).alias("last"))
        .first()["last"]
    )
    return last is not None and not last["finished"]


def append_rows(rows: DataFrame, table: str) -> None:
    """Append, one at a time: entities loaded side by side share their audit tables."""
    with _one_append_at_a_time:
        rows.write.mode("append").saveAsTable(table)


def append_ledger(rows: DataFrame, ledger_table: str) -> None:
    """Append to the ledger, which a new one is partitioned by table for: a load reads the history of its own tables alone."""
    with _one_append_at_a_time:
        spark = rows.sparkSession
        columns = partition_columns(spark, ledger_table) if table_exists(spark, ledger_table) else ["table_name"]
        writer = rows.write.mode("append")
        (writer.partitionBy(*columns) if columns else writer).saveAsTable(ledger_table)


def unprocessed_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed files that the ledger does not have in this version."""
    return listing.join(ledger.select(*LEDGER_KEY), LEDGER_KEY, "left_anti")


def unprocessed_for(
    spark: SparkSession, listing: DataFrame, ledger_table: str, tables: list[str]
) -> DataFrame:
    """Files that some of the tables lacks, with ``lacking``: the tables that do; the ledger may not exist yet."""
    if not table_exists(spark, ledger_table):
        return listing.withColumn("lacking", F.array(*[F.lit(table) for table in tables]))
    held = (
        spark.table(ledger_table)
        .where(F.col("table_name").isin(tables))
        .groupBy(*LEDGER_KEY)
        .agg(F.collect_set("table_name").alias("held"))
    )
    every = F.array(*[F.lit(table) for table in tables])
    lacking = F.coalesce(F.array_except(every, F.col("held")), every)
    return listing.join(held, LEDGER_KEY, "left").withColumn("lacking", lacking).drop("held").where(F.size("lacking") > 0)
