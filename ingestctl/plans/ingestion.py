"""Config-driven ingestion of landing files, entity by entity."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestctl.operators import publish
from ingestctl.operators.audit import (
    append_ledger,
    append_rows,
    audit_row,
    ledger_rows,
    load_is_unfinished,
    record_once,
    unprocessed_for,
)
from ingestctl.operators.config import require_unique_entities, select_config
from ingestctl.operators.shape import derive, impose_schema
from ingestctl.operators.rules import Rule, checked, require_passed, result_rows, rules_by_entity
from ingestctl.operators.sinks import RAW_PARTITION, WriteCounts, staged_target, raw_rows, write_table
from ingestctl.scratch import materialise, small_frame
from ingestctl.sources.files import (
    RAGGED_LINE,
    as_raw,
    data_line_width,
    discover_files,
    has_data,
    literal_path,
    parse_delimited,
    parse_fixed_width,
    read_delimited,
    read_lines,
)
from ingestctl.sources.tables import table_exists, table_schema
from ingestctl.spec import IngestSpec, parse_positions

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("entity_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n_files", T.LongType()),
        T.StructField("file_row_count", T.LongType()),
        T.StructField("ragged_row_count", T.LongType()),
        T.StructField("error_message", T.StringType()),
    ]
)


@dataclass
class EntityResult:
    """SUCCESS, FAILURE, NO_FILES or EMPTY, with what was loaded; ragged rows had too few or too many fields."""

    entity_name: str
    status: str
    n_files: int = 0
    file_row_count: int = 0
    ragged_row_count: int = 0
    error_message: str | None = None

    def as_row(self) -> tuple:
        return (
            self.entity_name,
            self.status,
            self.n_files,
            self.file_row_count,
            self.ragged_row_count,
            self.error_message,
        )


def ingest_all(
    spark: SparkSession,
    config: DataFrame,
    project_id: str,
    dept_id: str,
    job_id: str,
    workflow_id: str | None = None,
    run_id: str | None = None,
    max_files_per_step: int = 50_000,
    concurrency: int = 1,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Ingest every entity configured for a job; one entity's failure does not stop the others.

    At most ``concurrency`` entities are loaded side by side. ``rules`` is a table of (entity_name,
    rule_name, condition, max_failed_share): the failures of a step are counted while it is written, the results
    go to the audit table's name with ``_rules``, and a step that breaks a rule fails as a whole.
    """
    entities = select_config(config, project_id, dept_id, job_id).collect()
    require_unique_entities([row["entity_name"] for row in entities])
    run = {"job_id": job_id, "workflow_id": workflow_id, "run_id": run_id}

    own_rules = rules_by_entity(rules)

    def load(row: Row) -> EntityResult:
        name = row["entity_name"]
        return ingest_entity(spark, row["config_elements"], run, max_files_per_step, name, own_rules.get(name))

    with ThreadPoolExecutor(max_workers=concurrency) as pool:
        results = list(pool.map(load, sorted(entities, key=lambda row: row["entity_name"])))
    return small_frame(spark, [result.as_row() for result in results], RESULT_SCHEMA)


def ingest_entity(
    spark: SparkSession,
    config: Row,
    run: dict[str, str | None],
    max_files_per_step: int = 50_000,
    entity_name: str = "",
    rules: list[Rule] | None = None,
) -> EntityResult:
    """Load the files of one entity that were not loaded before; whatever fails is in the result.

    Files are taken in steps of bounded number, oldest first. Each step writes its rows and its
    ledger rows, then the raw copy with its own ledger rows, then the audit. Rows and ledger
    are one decision: a step is staged beside the table, and from its manifest on the next run
    completes it, however the driver ended. Ledger rows say which load they belong to and
    whether it is finished, so a rerun after a failure goes on behind the last good step, and
    appends to what the unfinished load has written.
    """
    result = EntityResult(entity_name, "NO_FILES")
    spec: IngestSpec | None = None
    files: list[Row] = []
    try:
        spec = IngestSpec.from_config(config)
        result.entity_name = spec.entity_name
        for counts, n_ragged in _steps(spark, spec, run, max_files_per_step, files, rules or []):
            if counts is None:
                result.status = "EMPTY" if result.status == "NO_FILES" else result.status
                continue
            names = [row["file_name"] for row in files]
            append_rows(audit_row(spark, spec, run, names, counts), spec.audit_table)
            result.status = "SUCCESS"
            result.n_files += len(files)
            result.file_row_count += counts.written
            result.ragged_row_count += n_ragged
    except Exception as error:
        result.status, result.error_message = "FAILURE", str(error)
        if spec is not None:
            try:
                names = [row["file_name"] for row in files]
                append_rows(audit_row(spark, spec, run, names, None, str(error)), spec.audit_table)
            except Exception as audit_error:
                result.error_message += f"; and the audit row was not written: {audit_error}"
    return result


def _steps(
    spark: SparkSession,
    spec: IngestSpec,
    run: dict[str, str | None],
    max_files: int,
    files: list[Row],
    rules: list[Rule],
) -> Iterator[tuple[WriteCounts | None, int]]:
    """Loads step by step and gives each step's counts (``None`` without data) and number of ragged rows.

    ``files`` holds the files of the step that is being loaded.
    """
    target, raw = spec.target_table, spec.raw_table if spec.raw_flag else None
    for table in filter(None, (raw, target)):
        for manifest in _complete(spark, spec, table):
            if table == target:
                files[:] = [Row(**entry) for entry in manifest.record["listed"]]
                n_after = spark.table(target).count()
                yield WriteCounts(0 if manifest.overwrite else n_after - manifest.n_rows, n_after, manifest.n_rows), 0
    listing = discover_files(spark, spec.source_path, spec.file_pattern)
    pending = materialise(
        unprocessed_for(spark, listing, spec.ledger_table, [target, raw] if raw else [target]), "pending"
    )
    resumed = load_is_unfinished(spark, spec.ledger_table, target)
    mode = "append" if resumed else spec.table_mode
    load_id, n_before, unmarked = uuid.uuid4().hex, None, resumed
    step_no = 0

    def entries(files: list[Row], finished: bool) -> dict:
        listed = [{name: row[name] for name in ("file_path", "file_name", "length", "version")} for row in files]
        return {"listed": listed, "run_id": run.get("run_id"), "load_finished": finished}

    more, last = True, None
    while more:
        files[:], more = _next_files(pending, last, max_files)
        if not files:
            break
        last = files[-1]
        step_no += 1
        step, loaded = _parsed(spark, spec, files), False
        counts, n_ragged = None, 0
        for_target = [row for row in files if target in row["lacking"]]
        if step is not None and for_target:
            if len(for_target) < len(files):
                step = _parsed(spark, spec, for_target)
            if step is not None:
                counts, n_ragged = _write_step(
                    spec, step, mode, n_before, f"{load_id}-{step_no}", entries(for_target, not more), rules
                )
                n_before, loaded = counts.after, True
                if counts.written or mode != "ignore":  # what is ignored stays pending
                    unmarked = more
                    mode = "append"
        for_raw = [row for row in files if raw and raw in row["lacking"]]
        if for_raw and (loaded or len(for_target) < len(files)):
            copy = raw_rows(as_raw(_lines(spark, spec, for_raw)), raw, spec.transformations)
            copied = load_rows(
                copy, raw, "append", RAW_PARTITION, spec.ledger_table, f"{load_id}-{step_no}", entries(for_raw, True)
            )
            counts = counts or copied
        yield counts, n_ragged
    if unmarked:
        mark = ledger_rows(spark, target, [], run.get("run_id"), load_id=load_id, load_finished=True)
        append_ledger(mark, spec.ledger_table)


def _complete(spark: SparkSession, spec: IngestSpec, table: str) -> list[publish.Manifest]:
    """Completes what an earlier run decided and did not complete."""
    target = publish.table_files(spark, table) if table_exists(spark, table) else None
    if target is None:
        return []

    def record(load_id: str, manifest: publish.Manifest) -> None:
        if manifest.record:  # a compaction has none
            record_once(spark, table, spec.ledger_table, load_id, **manifest.record)

    return [manifest for manifest in publish.recover(target, record) if manifest.record]


def load_rows(
    df: DataFrame,
    table: str,
    mode: str,
    partition_column: str | None,
    ledger_table: str,
    load_id: str,
    entries: dict,
    before: int | None = None,
    check: Callable[[], None] = lambda: None,
) -> WriteCounts:
    """Write rows and ledger rows as one decision, in the given mode; tables of other formats than plain files
    are written first and recorded then.

    ``entries`` are the ledger rows: the files as ``listed``, ``run_id`` and ``load_finished``. ``check`` may refuse
    the rows when they are staged; other tables have them by then.
    """
    spark = df.sparkSession
    mode = mode.lower()
    existed = table_exists(spark, table)
    target = staged_target(df, table, mode, partition_column) if mode in ("append", "overwrite") else None
    if target is not None:
        before = (spark.table(table).count() if existed else 0) if before is None else before
        written = publish.stage(df, target, load_id)
        try:
            check()
        except Exception:
            publish.finish(target, load_id)
            raise
        publish.decide(target, load_id, publish.Manifest(written, mode == "overwrite", record=entries))
        publish.publish(target, load_id)
        record_once(spark, table, ledger_table, load_id, **entries)
        publish.finish(target, load_id)
        return WriteCounts(before, written if mode == "overwrite" else before + written, written)
    counts = write_table(df, table, mode, partition_column, rebalance=True, before=before)
    if counts.written:
        check()
    if counts.written or mode != "ignore":
        record_once(spark, table, ledger_table, load_id, **entries)
    return counts


def _next_files(pending: DataFrame, last: Row | None, limit: int) -> tuple[list[Row], bool]:
    """The next files in (time, path) order, at most ``limit`` of them, and whether there are more."""
    if last is not None:
        pending = pending.where(
            (F.col("version") > last["version"])
            | ((F.col("version") == last["version"]) & (F.col("path") > last["path"]))
        )
    files = pending.orderBy("version", "path").limit(limit + 1).collect()
    return files[:limit], len(files) > limit


def _lines(spark: SparkSession, spec: IngestSpec, files: list[Row]) -> DataFrame:
    paths = [literal_path(row["path"]) for row in files]
    return read_lines(spark, paths, spec.skip_lines, total_bytes=sum(row["length"] for row in files))


def _parsed(spark: SparkSession, spec: IngestSpec, files: list[Row]) -> tuple[DataFrame, Observation] | None:
    """The rows of the given files as the target wants them, counting ragged ones; ``None`` without a data line."""
    paths = [literal_path(row["path"]) for row in files]
    lines = _lines(spark, spec, files)
    first = (lines if spec.fixed_width else lines.where(has_data("value"))).head(1)
    if not first:
        return None
    names = _column_names(spark, spec, first[0]["value"])
    if spec.fixed_width:
        df = parse_fixed_width(lines, names, spec.positions or "")
    elif spec.skip_lines:
        df = parse_delimited(lines, names, spec.delimiter, mark_ragged=True)
    else:
        df = read_delimited(spark, paths, names, spec.delimiter, mark_ragged=True)
    ragged = Observation()
    if not spec.fixed_width:
        n_ragged = F.count_if(F.col(RAGGED_LINE).isNotNull()).alias("n_rows")
        df = df.observe(ragged, n_ragged).drop(RAGGED_LINE)
    df = derive(df, spec.transformations)
    schema = table_schema(spark, spec.target_table)
    if schema is not None:
        df = impose_schema(df, schema, extras="error")
    return df, ragged


def _write_step(
    spec: IngestSpec,
    step: tuple[DataFrame, Observation],
    mode: str,
    n_before: int | None,
    load_id: str,
    entries: dict,
    rules: list[Rule],
) -> tuple[WriteCounts, int]:
    df, ragged = step
    spark, table = df.sparkSession, spec.target_table
    with_rules = checked(df, rules) if rules else None

    def check() -> None:
        if with_rules is not None:
            results = with_rules.results()
            told = result_rows(spark, spec.entity_name, table, entries["run_id"], load_id, results)
            append_rows(told, spec.rules_table)
            require_passed(results)

    rows = with_rules.rows if with_rules is not None else df
    counts = load_rows(
        rows, table, mode, spec.partition_column, spec.ledger_table, load_id, entries, n_before, check
    )
    return counts, ragged.get["n_rows"] if counts.written and not spec.fixed_width else 0


def _column_names(spark: SparkSession, spec: IngestSpec, line: str) -> list[str]:
    """Header names, checked against the first data line; positional names without a header."""
    if spec.fixed_width:
        width = len(parse_positions(spec.positions or ""))
    else:
        width = data_line_width(spark, line, spec.delimiter)
    if not spec.header_flag or not spec.header:
        return spec.header if spec.fixed_width else [f"_c{i}" for i in range(width)]
    if width != len(spec.header):
        raise ValueError(
            f"column count mismatch: {width} columns in the files, {len(spec.header)} in the header"
        )
    return spec.header
