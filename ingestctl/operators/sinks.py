"""Table writes with counts, raw copies, and truncate-and-load loops."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestctl.operators.publish import TableFiles, table_files
from ingestctl.operators.shape import derive, impose_schema
from ingestctl.scratch import small_frame
from ingestctl.sources.tables import partition_columns as partition_columns_of
from ingestctl.sources.tables import table_exists, table_provider
from ingestctl.spec import parse_partition_columns, parse_transformations

RAW_PARTITION = "PartitionColumn"
_OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"

LOAD_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("error_message", T.StringType()),
    ]
)


@dataclass(frozen=True)
class WriteCounts:
    """Rows in the table before and after a write, and rows written."""

    before: int
    after: int
    written: int


def write_table(
    df: DataFrame,
    table: str,
    mode: str = "append",
    partition_columns: str | list[str] | None = None,
    rebalance: bool = False,
    before: int | None = None,
    table_format: str | None = None,
) -> WriteCounts:
    """Write in the given mode; rows are counted while they are written, not by another scan.

    An existing table keeps its partitioning where none is given, and its format; a new one has
    ``table_format``, else the session's default.

    A write does not shuffle. Where a load has many partition values, ``rebalance`` spends one
    shuffle to bring a value's rows into few files; adaptive execution still splits a hot value
    over many tasks. The count comes last, after any shuffle, so that a recomputed map task
    cannot add to it. ``before`` saves counting the table where its row count is known.
    """
    spark = df.sparkSession
    mode = mode.lower()
    exists = table_exists(spark, table)
    if before is None:
        before = spark.table(table).count() if exists else 0
    if exists and mode == "ignore":
        return WriteCounts(before, before, 0)
    columns = parse_partition_columns(partition_columns)
    if exists and not columns:
        columns = partition_columns_of(spark, table)
    if columns and rebalance:
        df = df.hint("rebalance", *columns)
    observed = Observation()
    writer = df.observe(observed, F.count(F.lit(1)).alias("n_rows")).write.mode(mode)
    table_format = (table_provider(spark, table) if exists else None) or table_format
    if table_format:
        writer = writer.format(table_format)
    if columns:
        writer = writer.partitionBy(*columns)
    writer.saveAsTable(table)
    written = observed.get["n_rows"]
    return WriteCounts(before, written if mode == "overwrite" else before + written, written)


def staged_target(
    df: DataFrame, table: str, mode: str, partition_columns: str | list[str] | None
) -> TableFiles | None:
    """The table, if rows for it can be staged beside it; where it does not exist, it is made without rows."""
    spark = df.sparkSession
    columns = parse_partition_columns(partition_columns)
    if not table_exists(spark, table):
        write_table(spark.createDataFrame([], df.schema), table, "append", columns)
    target = table_files(spark, table)
    if target is None or mode == "append" or not columns or columns == target.partition_columns:
        return target
    return None  # it gets another partitioning


def write_raw(raw: DataFrame, table: str, transformations: str | None) -> WriteCounts:
    """Append raw lines, partitioned by a column that the transformations must create."""
    return write_table(raw_rows(raw, table, transformations), table, "append", RAW_PARTITION, rebalance=True)


def raw_rows(raw: DataFrame, table: str, transformations: str | None) -> DataFrame:
    """Raw lines with the partition column that the transformations must create.

    The other transformations are about the parsed columns, which a raw line does not have.
    """
    entries = [entry for entry in parse_transformations(transformations) if entry[0] == RAW_PARTITION]
    if not entries:
        raise ValueError(f"raw copy to {table}: the transformations must create {RAW_PARTITION}")
    return derive(raw, entries)


def truncate_and_load(
    spark: SparkSession,
    names: Iterable[str],
    reader: Callable[[str], DataFrame],
    target_schema: str,
    concurrency: int = 15,
) -> DataFrame:
    """Replace the rows of each named table with what ``reader(name)`` gives.

    An existing table keeps its columns and types; all its rows go, also those of partitions that
    the new rows do not have, whatever the session's overwrite mode. Tables are independent: at most
    ``concurrency`` loads run side by side and a failing one does not stop the others.
    """

    def load(name: str) -> tuple[str, str, int | None, str | None]:
        try:
            return name, "SUCCESS", _replace_rows(reader(name), f"{target_schema}.{name}"), None
        except Exception as error:
            return name, "FAILURE", None, str(error)

    before = spark.conf.get(_OVERWRITE_MODE)
    spark.conf.set(_OVERWRITE_MODE, "static")
    try:
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            rows = list(pool.map(load, names))
    finally:
        spark.conf.set(_OVERWRITE_MODE, before)
    return small_frame(spark, rows, LOAD_SCHEMA)


def _replace_rows(df: DataFrame, table: str) -> int:
    spark = df.sparkSession
    if not table_exists(spark, table):
        return write_table(df, table, "overwrite").written
    observed = Observation()
    imposed = impose_schema(df, spark.table(table).schema, extras="error")
    imposed.observe(observed, F.count(F.lit(1)).alias("n_rows")).write.insertInto(table, overwrite=True)
    return observed.get["n_rows"]
