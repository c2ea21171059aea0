"""Loads in two phases: rows are staged beside a table's files, and moved among them by one decision.

A load's folder below ``_staging`` in the table's own location is its intent. Spark does not see
it, as its name begins with ``_``. When all rows are staged, a manifest is put there in one
rename: from then on the load counts, and whatever ends it, ``recover`` completes it. Without a
manifest it never was. Every step after the manifest can be repeated: a file is moved if it is
still there, a ledger row is added if it is missing, and the folder goes last.

This is for tables of plain files, whose formats know no transactions; on a table format that
commits by itself, a write needs none of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ingestctl.sources.tables import partition_columns, table_detail

STAGING, MANIFEST, CLEARED, DATA = "_staging", "manifest.json", "cleared", "rows"
#: Formats whose tables are the files below their location.
FILE_FORMATS = {"parquet", "orc"}
_SIDE_BY_SIDE = 16


@dataclass(frozen=True)
class Manifest:
    """What completing a load takes: whether its rows replace all others, which files they replace, and what to record."""

    n_rows: int
    overwrite: bool = False
    replaced: list[str] = field(default_factory=list)
    record: dict[str, Any] = field(default_factory=dict)


class Folder:
    """A folder of any file system that Spark's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self._files.Path(f"{self.path}/{name}" if name else self.path)

    def below(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path())] if self.exists() else []

    def files(self) -> list[str]:
        """Paths of all visible files at any depth, relative to the folder."""
        if not self.exists():
            return []
        root, found = self.fs.makeQualified(self._path()).toString() + "/", []
        listed = self.fs.listFiles(self._path(), True)
        while listed.hasNext():
            relative = listed.next().getPath().toString().removeprefix(root)
            if not any(part.startswith(("_", ".")) for part in relative.split("/")):
                found.append(relative)
        return found

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def write(self, name: str, text: str) -> None:
        """All of the text or none, under that name."""
        draft = self._path(f"{name}.draft")
        stream = self.fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.rename(draft, self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move_in(self, source: Folder, name: str) -> None:
        """A file of another folder of the same file system; nothing if it has been moved before."""
        if source.exists(name):
            parent = self._path(name).getParent()
            self.fs.mkdirs(parent)
            if not self.fs.rename(source._path(name), self._path(name)) and not self.exists(name):
                raise OSError(f"{source.path}/{name} cannot be moved to {self.path}")


@dataclass(frozen=True)
class TableFiles:
    """A table that is the files below its location."""

    spark: SparkSession
    name: str
    provider: str
    folder: Folder
    partition_columns: list[str]
    partitions_listed: bool  # whether the catalogue keeps a list of them

    def load(self, load_id: str) -> Folder:
        return self.folder.below(f"{STAGING}/{load_id}")


def table_files(spark: SparkSession, table: str) -> TableFiles | None:
    """``None`` for a table of another kind, a bucketed one included."""
    detail = table_detail(spark, table)
    provider = detail.get("Provider", "").lower()
    if provider not in FILE_FORMATS or "Location" not in detail or "Num Buckets" in detail:
        return None
    listed = detail.get("Partition Provider") == "Catalog"
    return TableFiles(spark, table, provider, Folder(spark, detail["Location"]), partition_columns(spark, table), listed)


def stage(df: DataFrame, target: TableFiles, load_id: str) -> int:
    """Write the rows below the table's staging folder and count them meanwhile; they are not part of the table yet."""
    columns = target.partition_columns
    if columns:
        df = df.hint("rebalance", *columns)
    observed = Observation()
    writer = df.observe(observed, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite")
    if columns:
        writer = writer.partitionBy(*columns)
    writer.format(target.provider).save(target.load(load_id).below(DATA).path)
    return observed.get["n_rows"]


def decide(target: TableFiles, load_id: str, manifest: Manifest) -> None:
    """From now on the staged rows count, and ``recover`` completes the load if nothing else does."""
    target.load(load_id).write(MANIFEST, json.dumps(vars(manifest)))


def publish(target: TableFiles, load_id: str) -> Manifest:
    """Move the staged files among the table's; may be repeated after it ended anywhere.

    Files that are replaced as a whole go before the new ones come, so a reader meets too few
    rows rather than double ones; files named in the manifest go after that.
    """
    own, load = target.folder, target.load(load_id)
    manifest = Manifest(**json.loads(load.read(MANIFEST)))
    if manifest.overwrite and not load.exists(CLEARED):
        for name in own.names():
            if not name.startswith(("_", ".")):
                own.delete(name)
        load.write(CLEARED, "")
    staged = load.below(DATA)
    with ThreadPoolExecutor(max_workers=_SIDE_BY_SIDE) as pool:
        list(pool.map(lambda name: own.move_in(staged, name), staged.files()))
        list(pool.map(own.delete, manifest.replaced))
    if target.partitions_listed:
        target.spark.catalog.recoverPartitions(target.name)
    target.spark.catalog.refreshTable(target.name)
    return manifest


def finish(target: TableFiles, load_id: str) -> None:
    target.folder.below(STAGING).delete(load_id)


def recover(target: TableFiles, record: Callable[[str, Manifest], None] | None = None) -> list[Manifest]:
    """Complete the decided loads that ended early, drop the undecided ones; gives what was completed.

    ``record(load_id, manifest)`` notes a load where it was to be noted, unless that has been done. One
    driver at a time may load a table.
    """
    completed = []
    for load_id in sorted(target.folder.below(STAGING).names()):
        if target.load(load_id).exists(MANIFEST):
            manifest = publish(target, load_id)
            if record is not None:
                record(load_id, manifest)
            completed.append(manifest)
        finish(target, load_id)
    return completed


@dataclass(frozen=True)
class Compacted:
    files_before: int
    files_after: int
    rows: int


def compact_table(
    spark: SparkSession, table: str, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> Compacted:
    """Rewrite a table in place as ``keep`` of its rows, in few files for each partition.

    Only the files that were there at the beginning are read and replaced, so rows that are
    appended meanwhile stay. The new files come before the old ones go: until then a reader meets
    kept rows twice, and never too few. A compaction that ended early is completed, or undone, by
    the next one or by the next load.
    """
    target = table_files(spark, table)
    if target is None:
        raise ValueError(f"{table} is not a table of plain files; its own format compacts it")
    recover(target)
    before = target.folder.files()
    n_rows = 0
    if before:
        columns = spark.table(table).schema
        reader = spark.read.format(target.provider).schema(columns).option("basePath", target.folder.path)
        rows = keep(reader.load([f"{target.folder.path}/{name}" for name in before])).select(*columns.names)
        load_id = f"compaction-{uuid.uuid4().hex}"
        n_rows = stage(rows if target.partition_columns else rows.hint("rebalance"), target, load_id)
        decide(target, load_id, Manifest(n_rows, replaced=before))
        publish(target, load_id)
        finish(target, load_id)
    return Compacted(len(before), len(target.folder.files()), n_rows)
