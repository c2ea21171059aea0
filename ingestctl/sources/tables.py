"""Tables of the session catalogue, and readers for table import loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def table_schema(spark: SparkSession, table: str) -> T.StructType | None:
    """Columns and types of a table, partition columns included once; ``None`` if absent."""
    return spark.table(table).schema if table_exists(spark, table) else None


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [column.name for column in spark.catalog.listColumns(table) if column.isPartition]


def table_detail(spark: SparkSession, table: str) -> dict[str, str]:
    """What the catalogue tells of an existing table besides its columns: Provider, Location and so on."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    names = [row["col_name"] for row in rows]
    after = names.index("# Detailed Table Information") if "# Detailed Table Information" in names else len(rows)
    return {row["col_name"]: row["data_type"] for row in rows[after + 1 :] if row["col_name"]}


def table_provider(spark: SparkSession, table: str) -> str | None:
    """The format of an existing table."""
    return table_detail(spark, table).get("Provider")


def jdbc_reader(spark: SparkSession, url: str, **options: str) -> Callable[[str], DataFrame]:
    """A reader for ``truncate_and_load``: source table name in, frame out.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read a
    large table over several connections.
    """
    return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def parquet_reader(spark: SparkSession, directory: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{directory}/{name}.parquet")
