import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ingestctl.operators.ordering import with_previous
from tests.conftest import rows


@pytest.fixture(autouse=True, params=["true", "false"])
def coalescing(spark, request):
    """Small slices are merged by default; without that the test data lies in several slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keys", [["g"], ["g", "h"], []])
@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_equals_lag(spark, keys, hot):
    rng = random.Random(len(keys))
    data = [
        ("hot" if rng.random() < hot else rng.choice("abcdef"), rng.choice([None, 1, 2]), i, f"v{rng.randrange(50)}")
        for i in range(3000)
    ]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, h int, o int, v string").repartition(5)
    wanted = df.withColumn("p", F.lag("v").over(Window.partitionBy(*keys).orderBy("o")))
    assert rows(with_previous(df, keys, ["o"], "v", "p")) == rows(wanted)


def test_hot_key_is_spread_over_slices(spark, coalescing):
    df = spark.range(20_000).selectExpr("'one' AS g", "id AS o", "cast(id AS string) AS v")
    previous = with_previous(df, ["g"], ["o"], "v", "p")
    assert previous.where("p IS NULL").count() == 1
    assert previous.where("p = o - 1").count() == 19_999
    slices = df.repartitionByRange("g", "o").groupBy(F.spark_partition_id()).count().collect()
    if coalescing == "false":
        assert len(slices) == 8 and max(row["count"] for row in slices) < 5_000


def test_value_among_the_order_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a")], "g int, t string")
    assert rows(with_previous(df, ["g"], ["t"], "t", "p")) == [(1, "a", None), (1, "b", "a")]
    assert rows(with_previous(df.where("g > 1"), ["g"], ["t"], "t", "p")) == []
