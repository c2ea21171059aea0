"""The shared folder for intermediate tables.

Lineage is cut by writing a table there and reading it back, so a lost executor costs
nothing that was already written, and the file sizes give the optimizer real statistics.
The unique side of a join is written first where the other side may have a hot key: a small
one is then broadcast, and a large one meets the join as a plain shuffle, which is what
adaptive execution can split (it leaves a join with an aggregate right below it alone).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own_folder: dict[str, str] = {}
_working: ContextVar[str | None] = ContextVar("working", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="ingestctl-")
    return _own_folder[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A path that nothing else uses, below the working folder if there is one, else the shared folder."""
    return f"{_working.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def working_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside lie in one folder, which is removed at the end.

    Frames that read them must be written elsewhere, or collected, before that.
    """
    folder = new_folder(spark, "working")
    token = _working.set(folder)
    try:
        yield folder
    finally:
        _working.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few driver-made rows (audit, ledger, results) as part of the plan: no Python worker, no job."""
    columns = {name: [row[i] for row in rows] for i, name in enumerate(schema.names)}
    return spark.createDataFrame(pa.table(columns), schema)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
