"""Order-dependent values without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ingestctl.scratch import materialise

_SLICE = "_slice"
_LAG = "_lag"
_FIRST = "_first"
_CARRIED = "_carried"


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """Add ``name``: the ``value`` of the preceding row of the same key, NULL for a key's first row.

    Equals ``lag(value) over (partition by keys order by order)`` for rows that differ in
    (keys, order), and ``keys`` may be empty. The rows are range-partitioned on (keys, order),
    so a key of any size is spread over many slices; only the last row of each slice is
    carried into the next one, and there are no more of those than slices.
    """
    columns = df.columns
    sliced = materialise(
        df.repartitionByRange(*keys, *order).withColumn(_SLICE, F.spark_partition_id()), "slices"
    )
    in_slice = Window.partitionBy(_SLICE, *keys).orderBy(*order)
    lagged = sliced.withColumn(_LAG, F.lag(value).over(in_slice)).withColumn(
        _FIRST, F.row_number().over(in_slice) == 1
    )
    fields = [F.col(column).alias(f"c{i}") for i, column in enumerate([*keys, *order, value])]
    last_rows = sliced.groupBy(_SLICE).agg(F.max(F.struct(*fields)).alias("last"))
    carried = last_rows.select(
        F.col(_SLICE), F.lag("last").over(Window.orderBy(_SLICE)).alias(_CARRIED)
    )
    continues: Column = F.col(_FIRST) & F.col(_CARRIED).isNotNull()
    for i, key in enumerate(keys):
        continues = continues & F.col(key).eqNullSafe(F.col(_CARRIED)[f"c{i}"])
    carried_value = F.col(_CARRIED)[f"c{len(fields) - 1}"]
    previous = F.when(continues, carried_value).otherwise(F.col(_LAG))
    return lagged.join(F.broadcast(carried), _SLICE, "left").select(
        *columns, previous.alias(name)
    )
