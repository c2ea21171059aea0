"""From parsed text rows to the columns and types of a target table."""

from __future__ import annotations

from functools import reduce
from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestctl.spec import parse_names, parse_transformations


_one_setting_at_a_time = Lock()


def rename_positional(df: DataFrame, header: str | list[str]) -> DataFrame:
    """Name the columns by position; the counts must agree."""
    names = parse_names(header)
    if not column_count_matches(df, names):
        raise ValueError(f"{len(df.columns)} columns found, {len(names)} names given")
    return df.toDF(*names)


def column_count_matches(df: DataFrame, expected: str | list[str]) -> bool:
    return len(df.columns) == len(parse_names(expected))


def column_count_report(lines: DataFrame, delimiter: str, expected: int) -> DataFrame:
    """Rows per field count of a ``value`` column, quoting ignored, and whether it is the expected one."""
    width = F.size(F.split("value", _literal_pattern(delimiter)))
    return (
        lines.select(width.cast("long").alias("width"))
        .groupBy("width")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("matches", F.col("width") == expected)
    )


def derive(df: DataFrame, transformations: str | list[tuple[str, str]] | None) -> DataFrame:
    """Add or replace columns in the given order; a later entry sees the earlier ones.

    A value that an expression cannot work with gives NULL, whatever the session says: the
    expressions take their error handling from the setting in force when they are resolved.
    """
    entries = transformations if isinstance(transformations, list) else parse_transformations(transformations)
    if not entries:
        return df
    conf = df.sparkSession.conf
    with _one_setting_at_a_time:
        ansi = conf.get("spark.sql.ansi.enabled")
        conf.set("spark.sql.ansi.enabled", "false")
        try:
            return reduce(lambda frame, entry: frame.withColumn(entry[0], F.expr(entry[1])), entries, df)
        finally:
            conf.set("spark.sql.ansi.enabled", ansi)


def lenient_cast(df: DataFrame, name: str, target: T.DataType) -> Column:
    """Cast that gives NULL for a malformed value; decimal text becomes its whole part in an integer column."""
    column = F.col(f"`{name}`")
    cast = column.try_cast(target)
    if isinstance(target, T.IntegralType) and isinstance(df.schema[name].dataType, T.StringType):
        text = F.trim(column)
        whole = F.regexp_extract(text, r"^([+-]?\d*)\.\d*$", 1)
        whole = F.when(whole.rlike(r"^[+-]?$"), F.lit("0")).otherwise(whole)
        is_decimal = text.rlike(r"^[+-]?\d*\.\d*$")
        return F.coalesce(cast, F.when(is_decimal, whole.try_cast(target)))
    return cast


def impose_schema(df: DataFrame, target: T.StructType, extras: str = "keep") -> DataFrame:
    """One projection to the target's columns and types.

    Malformed values and missing columns become NULL of the target type. Columns the target
    lacks follow at the end (``extras='keep'``) or raise (``extras='error'``).
    """
    present = {name.lower(): name for name in df.columns}
    wanted = {field.name.lower() for field in target.fields}
    surplus = [name for name in df.columns if name.lower() not in wanted]
    if surplus and extras == "error":
        raise ValueError(f"columns not in the target table: {surplus}")
    imposed = [
        (
            lenient_cast(df, present[field.name.lower()], field.dataType)
            if field.name.lower() in present
            else F.lit(None).cast(field.dataType)
        ).alias(field.name)
        for field in target.fields
    ]
    return df.select(*imposed, *[F.col(f"`{name}`") for name in surplus])


def missing_columns(df: DataFrame, target: T.StructType) -> list[str]:
    present = {name.lower() for name in df.columns}
    return [field.name for field in target.fields if field.name.lower() not in present]


def is_all_null(columns: list[str]) -> Column:
    return reduce(lambda left, right: left & right, [F.col(f"`{name}`").isNull() for name in columns])


def all_null_report(df: DataFrame) -> DataFrame:
    """One row: rows with a value in some column, and rows without any."""
    empty = is_all_null(df.columns)
    return df.agg(
        F.count_if(empty).alias("n_all_null"),
        F.count_if(~empty).alias("n_with_value"),
    )


def _literal_pattern(delimiter: str) -> str:
    return r"\Q" + delimiter + r"\E"
