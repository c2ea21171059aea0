"""Landing files: discovery, raw lines, delimited and fixed-width scans."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestctl.functions.text import fixed_width_columns
from ingestctl.scratch import new_folder, small_frame
from ingestctl.spec import normalise_delimiter, parse_bytes, parse_names, parse_positions

RAGGED_LINE = "_ragged_line"

# monotonically_increasing_id() keeps the row's position in its task in the lower 33 bits.
_ROW_IN_TASK = (1 << 33) - 1


def discover_files(spark: SparkSession, directory: str | list[str], pattern: str = "*") -> DataFrame:
    """List the files of a directory whose whole name matches a glob (``*``, ``?``, ``[ ]``).

    ``version`` is the modification time in microseconds. File contents are not read: the
    ``content`` column is pruned from the scan.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(directory)
        .select(
            F.col("path"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("length"),
            F.col("modificationTime").alias("modification_time"),
            F.unix_micros("modificationTime").alias("version"),
        )
    )


def literal_path(path: str) -> str:
    """A path to read as it is, glob characters in it escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def source_files(df: DataFrame) -> DataFrame:
    """The distinct files a frame was read from; ``df`` must come straight from a file scan."""
    return df.select(F.col("_metadata.file_path").alias("file_path")).distinct()


def read_lines(
    spark: SparkSession,
    paths: str | list[str],
    skip: int = 0,
    pattern: str | None = None,
    total_bytes: int | None = None,
) -> DataFrame:
    """Lines as (value, file_path), without the first ``skip`` lines of each file.

    Files are split as usual. Skipping costs no second read: with the cost of opening a file
    set to a full partition, every split gets a task of its own, so the row position in the
    task is the line position in the split. Where the skipped lines reach beyond a file's first
    split, a small table says how many to drop of each. With the size of all files known, small
    inputs are split finer, as Spark does by itself.
    """
    if skip == 0:
        return _text_reader(spark, pattern).text(paths).select("value", "_metadata.file_path")

    reader = _session_with_one_split_per_task(spark, total_bytes)
    numbered = _text_reader(reader, pattern).text(paths).select(
        "value",
        "_metadata.file_path",
        "_metadata.file_block_start",
        "_metadata.file_block_length",
        "_metadata.file_size",
        F.monotonically_increasing_id().alias("row_id"),
    )
    drops = _lines_to_drop(spark, numbered, skip)
    view = f"lines_{uuid.uuid4().hex}"
    numbered.createGlobalTempView(view)
    try:
        lines = spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}")
    finally:
        spark.catalog.dropGlobalTempView(view)
    row_in_split = F.col("row_id").bitwiseAND(F.lit(_ROW_IN_TASK))
    if drops is None:
        kept = lines.where((F.col("file_block_start") > 0) | (row_in_split >= skip))
    else:
        kept = lines.join(drops, ["file_path", "file_block_start"], "left").where(
            row_in_split >= F.coalesce("to_drop", F.lit(0))
        )
    return kept.select("value", "file_path")


def has_data(line: str) -> Column:
    """Whether a line has a character above U+0020: the CSV scan drops lines without one, too."""
    return F.col(line).rlike(r"[^\x00-\x20]")


def _lines_to_drop(spark: SparkSession, numbered: DataFrame, skip: int) -> DataFrame | None:
    """(file_path, file_block_start, to_drop) of the splits with lines to skip; None if first splits hold them all.

    A task reads as many lines of its split as are to be skipped, and only files whose first
    split has fewer need more than that: the lines ahead of each split are then summed, a row
    per split. A frame whose files are not split is not read at all.
    """
    if numbered.rdd.getNumPartitions() <= len(numbered.inputFiles()):
        return None

    def lines_ahead(batches):
        seen, split = 0, None
        for batch in batches:
            if split is None:
                split = batch.iloc[:1]
            seen += len(batch)
            if seen >= skip:
                break
        if split is not None:
            yield split.assign(n_lines=min(seen, skip))

    columns = "file_path string, file_block_start long, file_block_length long, file_size long"
    heads = numbered.select("file_path", "file_block_start", "file_block_length", "file_size").mapInPandas(
        lines_ahead, f"{columns}, n_lines long"
    )
    split_first = (F.col("file_block_start") == 0) & (F.col("file_block_length") < F.col("file_size"))
    if not heads.where(split_first & (F.col("n_lines") < skip)).limit(1).collect():
        return None
    earlier = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(skip) - F.coalesce(F.sum("n_lines").over(earlier), F.lit(0))
    drops = heads.select("file_path", "file_block_start", F.least("n_lines", left).alias("to_drop")).where("to_drop > 0")
    path = new_folder(spark, "heads")
    drops.write.parquet(path)
    return spark.read.schema(drops.schema).parquet(path)


def as_raw(lines: DataFrame) -> DataFrame:
    """Lines as one ``raw_data`` column."""
    return lines.select(F.col("value").alias("raw_data"))


def data_line_width(spark: SparkSession, line: str, delimiter: str) -> int:
    """Number of fields of one line, with quoting respected."""
    schema = F.schema_of_csv(F.lit(line), {"sep": normalise_delimiter(delimiter)})
    one_row = small_frame(spark, [(line,)], T.StructType([T.StructField("line", T.StringType())]))
    return len(T.DataType.fromDDL(one_row.select(schema).first()[0]).fields)


def parse_delimited(
    lines: DataFrame, names: str | list[str], delimiter: str, mark_ragged: bool = False
) -> DataFrame:
    """Delimited lines as string columns named by position.

    Short rows are filled with NULL and long rows cut; blank lines are dropped. With
    ``mark_ragged`` a last column holds the line of such a short or long row, else NULL.
    """
    schema, options = _delimited_format(names, delimiter, mark_ragged)
    row = F.from_csv("value", schema, options)
    return lines.where(has_data("value")).select(row.alias("row")).select("row.*")


def parse_fixed_width(lines: DataFrame, names: str | list[str], positions: str) -> DataFrame:
    """Fixed-width lines: one untrimmed string column per ``start-end`` range."""
    return lines.select(*fixed_width_columns("value", parse_names(names), parse_positions(positions)))


def read_delimited(
    spark: SparkSession,
    paths: str | list[str],
    names: str | list[str],
    delimiter: str,
    skip: int = 0,
    pattern: str | None = None,
    mark_ragged: bool = False,
) -> DataFrame:
    """``parse_delimited`` of files; without lines to skip the CSV scan does the same a little faster."""
    if skip:
        lines = read_lines(spark, paths, skip, pattern)
        return parse_delimited(lines, names, delimiter, mark_ragged)
    schema, options = _delimited_format(names, delimiter, mark_ragged)
    return _text_reader(spark, pattern).schema(schema).options(**options).csv(paths)


def _delimited_format(
    names: str | list[str], delimiter: str, mark_ragged: bool
) -> tuple[str, dict[str, str]]:
    options = {"sep": normalise_delimiter(delimiter)}
    columns = parse_names(names)
    if mark_ragged:
        columns = [*columns, RAGGED_LINE]
        options["columnNameOfCorruptRecord"] = RAGGED_LINE
    return ", ".join(f"`{name}` STRING" for name in columns), options


def _session_with_one_split_per_task(spark: SparkSession, total_bytes: int | None = None) -> SparkSession:
    """A session like the caller's, but for how splits are packed into tasks."""
    reader = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if not key.startswith("spark.") or spark.conf.isModifiable(key):
            reader.conf.set(key, value)
    split_size = parse_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if total_bytes is not None:
        smallest = parse_bytes(spark.conf.get("spark.sql.files.openCostInBytes"))
        per_core = total_bytes // spark.sparkContext.defaultParallelism
        split_size = min(split_size, max(smallest, per_core))
    reader.conf.set("spark.sql.files.maxPartitionBytes", str(split_size))
    reader.conf.set("spark.sql.files.openCostInBytes", str(split_size))
    reader.conf.unset("spark.sql.files.maxPartitionNum")
    return reader


def _text_reader(spark: SparkSession, pattern: str | None):
    return spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)

