"""Session settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Joins leave a hot key to adaptive execution, which splits its rows over many tasks; the last
# setting lets it do so where a later step then needs one more shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
