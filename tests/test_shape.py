import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from ingestctl.operators import shape
from tests.conftest import rows


def schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_rename_needs_the_same_count(spark):
    df = spark.createDataFrame([("1", "2")], "_c0 string, _c1 string")
    assert shape.rename_positional(df, "a, b").columns == ["a", "b"]
    with pytest.raises(ValueError):
        shape.rename_positional(df, "a,b,c")


def test_derive_in_order_and_replace(spark):
    df = spark.createDataFrame([(2,)], "a int")
    spec = """[{"column_name": "b", "transformation_logic": "a + 1"},
               {"column_name": "a", "transformation_logic": "b * 10"},
               {"column_name": "c", "transformation_logic": "a + b"}]"""
    assert rows(shape.derive(df, spec)) == [(30, 3, 33)]
    assert shape.derive(df, "").columns == ["a"]


def test_impose_types_malformed_missing_and_extra(spark):
    df = spark.createDataFrame([("1", "x", "2024-01-02"), ("oops", "y", "never")], "A string, extra string, d string")
    target = schema(spark, "a bigint, d date, gone decimal(5,2)")
    imposed = shape.impose_schema(df, target)
    assert imposed.columns == ["a", "d", "gone", "extra"]
    assert imposed.schema["gone"].dataType == T.DecimalType(5, 2)
    assert [row["a"] for row in imposed.collect()] == [1, None]
    assert [str(row["d"]) for row in imposed.collect()] == ["2024-01-02", "None"]
    assert shape.missing_columns(df, target) == ["gone"]
    with pytest.raises(ValueError, match="extra"):
        shape.impose_schema(df, target, extras="error")


def test_whole_part_of_decimal_text(spark):
    """What a cast without ANSI mode gives."""
    texts = ["12.7", " 12 ", "x", ".5", "-3.9", "99999999999", "1e3", "5.", "5.x", ".", "+7.2", "", None]
    df = spark.createDataFrame([(text,) for text in texts], "n string")
    got = [row["n"] for row in shape.impose_schema(df, schema(spark, "n int")).collect()]
    assert got == [12, 12, None, 0, -3, None, None, 5, None, 0, 7, None, None]


def test_nested_target_is_rejected_when_planned(spark):
    df = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(AnalysisException):
        shape.impose_schema(df, schema(spark, "a array<int>"))


def test_impose_adds_one_projection(spark):
    df = spark.range(1).selectExpr(*[f"cast(id AS string) AS c{i}" for i in range(30)])
    imposed = shape.impose_schema(df, schema(spark, ", ".join(f"c{i} bigint" for i in range(30))))
    assert imposed._jdf.queryExecution().optimizedPlan().toString().count("Project") == 2


def test_all_null_report(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, None)], "a int, b string")
    assert rows(shape.all_null_report(df)) == [(2, 1)]


def test_column_count_report_with_a_pattern_character(spark):
    df = spark.createDataFrame([("a|b",), ("a|b|",), ("a",)], "value string")
    assert rows(shape.column_count_report(df, "|", 2)) == [(1, 1, False), (2, 1, True), (3, 1, False)]
