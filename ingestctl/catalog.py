"""The registered queries: each takes (spark, directory of the test tables) and gives a frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestctl import fixtures as fx
from ingestctl.functions.text import json_list
from ingestctl.operators import audit, config, control, lineage, publish, shape, sinks, taskgraph
from ingestctl.operators.publish import compact_table
from ingestctl.plans.ingestion import ingest_all
from ingestctl.plans.tasks import run_all, run_sql_script
from ingestctl.scratch import materialise, new_folder
from ingestctl.session import configure
from ingestctl.sources import files
from ingestctl.sources.tables import parquet_reader

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name, to run with the settings the operators count on."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def _land(spark: SparkSession, df: DataFrame, delimiter: str = "|", header_lines: int = 2) -> str:
    folder = new_folder(spark, "landing")
    return fx.write_landing(df, folder, fx.delimited_line(df, delimiter), header_lines)


def _run(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return ingest_all(spark, fx.config_frame(spark, rows), "p1", "d1", "load", "w1", "r1")


def _require_success(results: DataFrame) -> None:
    failed = results.where(F.col("status") != "SUCCESS").collect()
    if failed:
        raise RuntimeError(f"ingestion failed: {failed}")


def _ingest_typed(spark: SparkSession, sf_dir: str, name: str, delimiter: str, configured: str) -> DataFrame:
    """Land a table as delimited text, ingest it into an empty table of the same types."""
    source = fx.table(spark, sf_dir, name)
    database = fx.new_database(spark)
    fx.create_like(spark, f"{database}.{name}", source)
    folder = _land(spark, source, delimiter)
    row = fx.config_row(database, name, folder, Delimiter=configured, Header=", ".join(source.columns))
    _require_success(_run(spark, [row]))
    return spark.table(f"{database}.{name}")


# Files in, tables out


@query
def ingest_delimited_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest_typed(spark, sf_dir, "customer", "|", "|")


@query
def ingest_resume_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overwriting load that fails in a later step, and goes on with the rest once that is corrected."""
    source = fx.table(spark, sf_dir, "customer")
    database, folder = fx.new_database(spark), new_folder(spark, "landing")
    fx.create_like(spark, f"{database}.customer", source)

    def land(df: DataFrame, compression: str = "none") -> None:
        lines = df.select(fx.delimited_line(df, "|").alias("value"))
        lines.write.mode("append").option("compression", compression).text(folder)

    def load(pattern: str) -> DataFrame:
        changes = {"Table_Mode": "overwrite", "Skiplines": 0, "File_Pattern": pattern}
        row = fx.config_row(database, "customer", folder, Header=", ".join(source.columns), **changes)
        config = fx.config_frame(spark, [row])
        return ingest_all(spark, config, "p1", "d1", "load", "w1", "r1", max_files_per_step=1)

    land(source.where("c_custkey % 2 = 0"))
    land(source.selectExpr("'too' AS a", "'few' AS b", "'columns' AS c").distinct(), "gzip")
    if load("*").first()["status"] != "FAILURE":
        raise RuntimeError("a file with another number of columns was loaded")
    land(source.where("c_custkey % 2 = 1"))
    _require_success(load("*.txt"))
    return spark.table(f"{database}.customer")


@query
def ingest_after_a_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads that end early, one before its rows count and one after, and the load that follows them."""
    source = fx.table(spark, sf_dir, "customer")
    database, folder = fx.new_database(spark), new_folder(spark, "landing")
    fx.create_like(spark, f"{database}.customer", source)
    target = publish.table_files(spark, f"{database}.customer")
    source.select(fx.delimited_line(source, "|").alias("value")).write.text(folder)
    changes = {"Skiplines": 0, "Header": ", ".join(source.columns)}
    row = fx.config_row(database, "customer", folder, **changes)
    publish.stage(source, target, "undecided")
    publish.stage(source.where("c_custkey % 2 = 0"), target, "decided")
    publish.decide(target, "decided", publish.Manifest(0, record={"listed": [], "run_id": "r0", "load_finished": True}))
    _require_success(_run(spark, [row]))
    return spark.table(f"{database}.customer")


@query
def ingest_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of two entities counted: orders break one of theirs, which are not loaded, customers do not."""
    database = fx.new_database(spark)
    configured = []
    for name in ("customer", "orders"):
        source = fx.table(spark, sf_dir, name)
        fx.create_like(spark, f"{database}.{name}", source)
        folder = _land(spark, source)
        configured.append(fx.config_row(database, name, folder, Header=", ".join(source.columns)))
    rules = spark.createDataFrame(
        [
            ("customer", "has key", "c_custkey IS NOT NULL", None),
            ("customer", "balance", "c_acctbal >= 0", 0.9),
            ("orders", "has key", "o_orderkey IS NOT NULL", 0.0),
            ("orders", "finished", "o_orderstatus <> 'O'", 0.01),
        ],
        "entity_name string, rule_name string, condition string, max_failed_share double",
    )
    config = fx.config_frame(spark, configured)
    ingest_all(spark, config, "p1", "d1", "load", "w1", "r1", rules=rules)
    told = spark.table(f"{database}.ingestion_audit_rules").select(
        "entity_name", "rule_name", "n_rows", "n_failed", "passed"
    )
    loaded = F.create_map(
        *[F.lit(v) for name in ("customer", "orders") for v in (name, spark.table(f"{database}.{name}").count())]
    )
    return told.withColumn("n_loaded", loaded[F.col("entity_name")].cast("long"))


@query
def ingest_delimited_ctrl_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest_typed(spark, sf_dir, "supplier", "\u0001", "x01")


@query
def ingest_delimited_cedilla(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest_typed(spark, sf_dir, "part", "Ç", "Ç")


@query
def ingest_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    line = F.concat(
        F.lpad(F.col("o_orderkey").cast("string"), 15, " "),
        F.rpad("o_orderpriority", 16, " "),
        F.lpad(F.col("o_custkey").cast("string"), 15, " "),
    )
    folder = fx.write_landing(orders, new_folder(spark, "landing"), line, 2)
    database = fx.new_database(spark)
    row = fx.config_row(
        database, "orders", folder, Delimiter="", Header="order_text, priority_text, cust_text",
        Fixed_Length_Position="1-15,16-31,32-46",
    )
    _require_success(_run(spark, [row]))
    return spark.table(f"{database}.orders")


@query
def ingest_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    database, raw = fx.new_database(spark), fx.new_database(spark)
    row = fx.config_row(
        database, "events", _land(spark, source), Header=",".join(source.columns), Raw_Schema=raw,
        Raw_Ingestion_Flag="Y",
        Transformations='[{"column_name": "PartitionColumn", "transformation_logic": "\'p0\'"}]',
    )
    _require_success(_run(spark, [row]))
    return spark.table(f"{raw}.events").select("raw_data", F.col("PartitionColumn").alias("partition_column"))


@query
def skip_leading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    folder = _land(spark, source, "|", 3)
    rows = files.read_delimited(spark, folder, source.columns, "|", skip=3)
    key, customer = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
        F.sum(customer).alias("sum_custkey"),
    )


@query
def skip_header_over_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading lines that fill several splits, as splits are small here."""
    source = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    folder = _land(spark, source, "|", 2_000)
    reader = spark.newSession()
    reader.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    rows = files.read_delimited(reader, folder, source.columns, "|", skip=2_000)
    return rows.select(*[F.col(name).cast("long").alias(name) for name in source.columns])


def _customers_by_nation(spark: SparkSession, sf_dir: str) -> str:
    nations = fx.table(spark, sf_dir, "nation")
    customers = fx.table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return fx.write_landing(
        customers, new_folder(spark, "landing"), F.col("c_custkey").cast("string"), by="n_name"
    )


def _folder_value(path: str) -> F.Column:
    return F.regexp_extract(path, r"/n_name=([^/]+)/", 1).alias("n_name")


def _rows_by_nation(lines: DataFrame, listing: DataFrame) -> DataFrame:
    """Lines per nation in the listed files; counted per file before the join."""
    per_file = lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    listed = per_file.join(listing, "file_path", "left_semi")
    return listed.groupBy(_folder_value("file_path")).agg(F.sum("n").alias("n_rows"))


@query
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _customers_by_nation(spark, sf_dir)
    where = f"{folder}/n_name=N?TION_1*"
    listing = files.discover_files(spark, where, "part-*.t[x]t")
    lines = files.read_lines(spark, where, pattern="part-*.t[x]t")
    return _rows_by_nation(lines, listing)


@query
def source_file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = spark.read.text(_customers_by_nation(spark, sf_dir))
    return files.source_files(read).select(_folder_value("file_path")).distinct()


@query
def unprocessed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _customers_by_nation(spark, sf_dir)
    listing = files.discover_files(spark, f"{folder}/*", "*.txt")
    loaded = files.discover_files(spark, f"{folder}/n_name=NATION_1*", "*.txt")
    pending = audit.unprocessed_files(listing, materialise(loaded, "ledger"))
    return _rows_by_nation(files.read_lines(spark, f"{folder}/*"), pending)


@query
def header_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    positional = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand").toDF("_c0", "_c1", "_c2")
    return shape.rename_positional(positional, "part_id, part_name , brand")


@query
def column_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.column_count_report(fx.ragged_lines(spark, sf_dir), "|", 3)


@query
def empty_input_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with no matching file, files with header lines only, and files with data."""
    source = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    folder = _land(spark, source)
    headers_only = new_folder(spark, "landing")
    spark.range(1).select(F.lit("# header 1\n# header 2")).write.text(headers_only)
    database, header = fx.new_database(spark), "c_custkey,c_name"
    rows = [
        fx.config_row(database, "no_files", folder, File_Pattern="*.dat", Header=header),
        fx.config_row(database, "no_rows", headers_only, Header=header),
        fx.config_row(database, "with_rows", folder, Header=header),
    ]
    results = _run(spark, rows)
    audited = spark.table(f"{database}.ingestion_audit").groupBy("entity_name").agg(
        F.count(F.lit(1)).alias("n_audit_rows")
    )
    return results.join(audited, "entity_name", "left").select(
        "entity_name", "status", "file_row_count", F.coalesce("n_audit_rows", F.lit(0)).alias("n_audit_rows")
    )


@query
def ingest_derived_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with derived columns into a typed table partitioned by return flag."""
    kept = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag"]
    source = fx.table(spark, sf_dir, "lineitem").select(*kept)
    database = fx.new_database(spark)
    spark.sql(
        f"CREATE TABLE {database}.lineitem (l_orderkey bigint, l_linenumber int, l_extendedprice double, "
        "l_discount double, l_shipdate timestamp_ntz, net double, ship_month string, load_note string, "
        "l_returnflag string) USING parquet PARTITIONED BY (l_returnflag)"
    )
    row = fx.config_row(
        database, "lineitem", _land(spark, source), Header=",".join(kept), Partition_Column="l_returnflag",
        Transformations="""[
          {"column_name": "net",
           "transformation_logic": "cast(l_extendedprice AS double) * (1 - cast(l_discount AS double))"},
          {"column_name": "ship_month", "transformation_logic": "substr(l_shipdate, 1, 7)"}]""",
    )
    _require_success(_run(spark, [row]))
    loaded = spark.table(f"{database}.lineitem")
    return loaded.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


# Columns


@query
def derive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = """[
      {"column_name": "net", "transformation_logic": "l_extendedprice * (1 - l_discount)"},
      {"column_name": "gross", "transformation_logic": "net * (1 + l_tax)"},
      {"column_name": "ship_month", "transformation_logic": "date_format(l_shipdate, 'yyyy-MM')"}]"""
    kept = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    derived = shape.derive(fx.table(spark, sf_dir, "lineitem").select(*kept), spec)
    return derived.select("l_orderkey", "l_linenumber", "net", "gross", "ship_month")


@query
def derive_replace_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = '[{"column_name": "c_name", "transformation_logic": "upper(c_name)"}]'
    return shape.derive(fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), spec)


@query
def impose_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    texts = orders.select(*[F.col(name).cast("string") for name in orders.columns if name != "o_orderpriority"])
    database = fx.new_database(spark)
    spark.sql(
        f"CREATE TABLE {database}.orders (o_orderkey bigint, o_custkey int, o_orderstatus string, "
        "o_totalprice decimal(12,2), o_orderdate timestamp_ntz, o_clerk string) USING parquet"
    )
    imposed = shape.impose_schema(texts, spark.table(f"{database}.orders").schema)
    return imposed.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_clerk",
    )


@query
def impose_schema_bad_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.createDataFrame([], "c_custkey bigint, c_nationkey int, c_acctbal double").schema
    imposed = shape.impose_schema(fx.dirty_customers(spark, sf_dir), target)
    return imposed.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))


@query
def all_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.createDataFrame([], "c_nationkey int, c_acctbal double").schema
    dirty = fx.dirty_customers(spark, sf_dir).drop("c_custkey")
    return shape.all_null_report(shape.impose_schema(dirty, target))


# Configuration


@query
def config_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = config.select_config(fx.entity_config(spark, sf_dir), "p1", "d1", "j3")
    elements = F.col("config_elements")
    return selected.select(
        "entity_name",
        elements["Src_Path"].alias("src_path"),
        elements["File_Pattern"].alias("file_pattern"),
        elements["Delimiter"].alias("delimiter"),
        elements["Skiplines"].alias("skiplines"),
    )


@query
def duplicate_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["project_id", "dept_id", "job_id", "Entity_Name"]
    return config.duplicate_entities(fx.entity_config(spark, sf_dir), keys).withColumnRenamed(
        "Entity_Name", "entity_name"
    )


# Sinks and audit


def _write_twice(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    source = fx.table(spark, sf_dir, "customer")
    target = f"{fx.new_database(spark)}.customer"
    counts = [sinks.write_table(source, target, mode) for _ in range(2)]
    first, second = [
        spark.table(target).agg(
            F.lit(step).cast("long").alias("step"),
            F.lit(c.before).alias("n_before"),
            F.lit(c.after).alias("n_after"),
            F.lit(c.written).alias("n_written"),
            F.count(F.lit(1)).alias("n_in_table"),
        )
        for step, c in enumerate(counts, 1)
    ]
    return first.unionByName(second)


@query
def write_append_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _write_twice(spark, sf_dir, "append")


@query
def write_overwrite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _write_twice(spark, sf_dir, "overwrite")


@query
def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{fx.new_database(spark)}.orders"
    sinks.write_table(fx.table(spark, sf_dir, "orders"), target, "append", "o_orderstatus")
    return spark.table(target).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_custkey").alias("sum_custkey")
    )


@query
def truncate_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = fx.new_database(spark)
    names, reader = ["customer", "supplier", "part", "orders"], parquet_reader(spark, sf_dir)
    sinks.truncate_and_load(spark, names, reader, database)
    loaded = sinks.truncate_and_load(spark, names, reader, database)
    counts = [
        spark.table(f"{database}.{name}").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_in_table")
        )
        for name in names
    ]
    found = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return loaded.select("table_name", "status", "n_rows").join(found, "table_name")


def _audit_columns(audited: DataFrame) -> DataFrame:
    return audited.select(
        "entity_name",
        "status",
        F.coalesce("previous_row_count_in_table", F.lit(-1)).alias("previous_row_count_in_table"),
        F.coalesce("new_row_count_in_table", F.lit(-1)).alias("new_row_count_in_table"),
        F.coalesce("file_row_count", F.lit(-1)).alias("file_row_count"),
        F.col("error_message").isNotNull().alias("has_error"),
        (F.size("file_names") > 0).alias("has_files"),
        "file_pattern",
        "job_id",
        "workflow_id",
        "run_id",
    )


@query
def audit_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = fx.new_database(spark)
    rows = []
    for name in ["customer", "supplier"]:
        source = fx.table(spark, sf_dir, name)
        header = ",".join(source.columns)
        rows.append(fx.config_row(database, name, _land(spark, source), Header=header))
    _require_success(_run(spark, rows))
    _run(spark, rows)
    return _audit_columns(spark.table(f"{database}.ingestion_audit"))


@query
def audit_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity's header is too short; the next one is loaded all the same."""
    database = fx.new_database(spark)
    source = fx.table(spark, sf_dir, "customer")
    folder = _land(spark, source)
    rows = [
        fx.config_row(database, "bad_header", folder, Header="c_custkey,c_name"),
        fx.config_row(database, "good_header", folder, Header=",".join(source.columns)),
    ]
    _run(spark, rows)
    return _audit_columns(spark.table(f"{database}.ingestion_audit"))


# Batches and job status


@query
def open_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.open_batch(fx.batches(spark, sf_dir))


@query
def job_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = control.status_view(fx.status_events(spark, sf_dir))
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return status.withColumn("start_time", F.date_format("start_time", stamp)).withColumn(
        "end_time", F.date_format("end_time", stamp)
    )


@query
def job_status_of_compacted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events, partitioned by batch and written in parts, is compacted in place and read again."""
    events = f"{fx.new_database(spark)}.job_events"
    for part in range(3):
        some = fx.status_events(spark, sf_dir).where(f"seq % 3 = {part}")
        some.write.mode("append").partitionBy("batch_id").saveAsTable(events)
    done = compact_table(spark, events, control.compact_events)
    if done.files_after >= done.files_before:
        raise RuntimeError(f"{done.files_before} files became {done.files_after}")
    status = control.status_view(spark.table(events))
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return status.withColumn("start_time", F.date_format("start_time", stamp)).withColumn(
        "end_time", F.date_format("end_time", stamp)
    )


@query
def already_executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = control.status_view(fx.status_events(spark, sf_dir))
    return control.already_executed(fx.jobs(spark, sf_dir), status)


@query
def runnable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = control.status_view(fx.status_events(spark, sf_dir))
    return control.runnable_jobs(fx.jobs(spark, sf_dir), status)


@query
def parent_job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the orders against the parameter rows of the customers that have any."""
    wanted = fx.table(spark, sf_dir, "orders").selectExpr(
        "concat('p', o_custkey % 3) AS proj_id",
        "concat('d', o_custkey % 2) AS dept_id",
        "concat('job', o_custkey) AS job_id",
        "o_orderkey",
    )
    return control.parent_jobs(wanted, fx.job_parameters(spark, sf_dir))


@query
def run_task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tasks over whole tables, of which one fails; the failure does not stop the others."""
    database = fx.new_database(spark)
    events = f"{database}.job_events"
    spark.catalog.createTable(events, schema=control.EVENT_SCHEMA)
    orders, parts = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "part")
    tasks = {
        "load_orders": lambda: sinks.write_table(orders, f"{database}.orders"),
        "check_parts": lambda: parts.select(
            F.assert_true(F.col("p_partkey") < 0, "negative keys only")
        ).write.format("noop").mode("overwrite").save(),
        "load_parts": lambda: sinks.write_table(parts, f"{database}.part"),
    }
    run_all(spark, events, tasks, batch_id=1, run_id="r1", proj_id="p1", dept_id="d1")
    status = control.status_view(spark.table(events))
    loaded = (
        spark.table(f"{database}.orders").agg(F.lit("load_orders").alias("job_id"), F.count(F.lit(1)).alias("n"))
    ).unionByName(
        spark.table(f"{database}.part").agg(F.lit("load_parts").alias("job_id"), F.count(F.lit(1)).alias("n"))
    )
    return status.join(loaded, "job_id", "left").select(
        "job_id",
        "status",
        F.col("error_message").contains("negative keys only").alias("has_error"),
        F.col("end_time").isNotNull().alias("has_ended"),
        F.coalesce("n", F.lit(0)).alias("n_rows"),
    )


@query
def sql_literal_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored query text with a double-quoted literal and bound parameters, written to a table."""
    target = f"{fx.new_database(spark)}.script_output"
    text = """SELECT "orders by status" AS message, o_orderstatus, count(*) AS n_orders
              FROM parquet.`{path}` WHERE o_totalprice >= :floor GROUP BY o_orderstatus"""
    run_sql_script(spark, text.format(path=f"{sf_dir}/orders.parquet"), {"floor": 1000.0}, target)
    return spark.table(target)


# Job metadata and task graphs


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    params = fx.job_parameters(spark, sf_dir)
    parents = taskgraph.parent_rows(params)
    return parents, taskgraph.child_rows(params, parents)


@query
def job_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = taskgraph.parent_rows(fx.job_parameters(spark, sf_dir))
    return parents.select(
        "esp_job_id", "proj_id", "dept_id", "job_id", F.size("job_params").cast("long").alias("n_params"),
        F.col("job_params")["env"].alias("env"),
    )


@query
def job_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return children.select(
        "esp_job_id", "invocation_id", "job_id", "task_name", F.col("use_runner").cast("string").alias("use_runner"),
        "notebook_path", "parameter_type",
    )


@query
def eav_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taskgraph.attribute_children(fx.job_attributes(spark, sf_dir))


@query
def eav_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = fx.job_attributes(spark, sf_dir).withColumn("invocation_id", F.col("invocation_id").cast("long"))
    return taskgraph.attribute_value(attributes, "notebook", "path")


@query
def json_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    payloads = taskgraph.task_payloads(children)
    return payloads.select(
        "esp_job_id",
        "task_name",
        "job_id",
        "is_valid",
        F.col("task_params")["catalog_name"].alias("catalog_name"),
        F.col("task_params")["schema_name"].alias("schema_name"),
        F.col("cluster_info")["job_cluster_key"].alias("cluster_key"),
        F.size("libraries").cast("long").alias("n_libraries"),
    )


@query
def depends_on_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return taskgraph.named_dependencies(children)


@query
def valid_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return taskgraph.valid_dependencies(children)


@query
def dropped_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return taskgraph.dropped_dependencies(children)


@query
def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children = _graph(spark, sf_dir)
    return taskgraph.task_edges(children, parents)


@query
def job_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children = _graph(spark, sf_dir)
    paths = {
        taskgraph.BATCH_CHECK: "control/batch",
        taskgraph.EXECUTION_CHECK: "control/executed",
        taskgraph.MARK_IN_PROGRESS: "control/mark",
        taskgraph.MARK_COMPLETED: "control/mark",
    }
    return taskgraph.job_tasks(children, parents, paths, "utility/runner_main")


@query
def task_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taskgraph.task_levels(fx.task_graph(spark, sf_dir))[0]


@query
def cyclic_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taskgraph.task_levels(fx.task_graph(spark, sf_dir))[1]


@query
def leaf_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return taskgraph.leaf_tasks(taskgraph.dependency_table(children))


@query
def linear_chain_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return taskgraph.linear_chain(children)


@query
def linear_chain_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children = _graph(spark, sf_dir)
    return taskgraph.linear_closing(children, parents)


@query
def job_level_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, _ = _graph(spark, sf_dir)
    return taskgraph.job_level_parameters(parents)


@query
def task_effective_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children = _graph(spark, sf_dir)
    return taskgraph.task_effective_parameters(children, parents)


@query
def task_runner_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return taskgraph.task_paths(children, "utility/runner_main")


@query
def cluster_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return taskgraph.cluster_registry(children)


@query
def task_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children = _graph(spark, sf_dir)
    by_parent = taskgraph.task_clusters(children, parents, "parent")
    return by_parent.distinct()


@query
def task_clusters_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children = _graph(spark, sf_dir)
    return taskgraph.task_clusters(children, parents, "own")


@query
def control_task_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, _ = _graph(spark, sf_dir)
    return taskgraph.control_task_clusters(parents)


@query
def job_cluster_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents, children = _graph(spark, sf_dir)
    return taskgraph.job_clusters(children, parents, "parent").select("esp_job_id", "cluster_key")


@query
def library_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = _graph(spark, sf_dir)
    return taskgraph.task_libraries(children)


@query
def foreach_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taskgraph.foreach_iterations(fx.loop_tasks(spark, sf_dir), json_list(F.col("loop_values")))


# Lineage


def _lineage(spark: SparkSession, sf_dir: str, expand=None) -> tuple[DataFrame, DataFrame]:
    edges = materialise(fx.lineage_edges(spark, sf_dir), "edges")
    return edges, lineage.expanded_tables(edges, fx.lineage_root(spark, sf_dir), expand)


@query
def upstream_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.upstream_tables(*_lineage(spark, sf_dir))


@query
def upstream_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, expanded = _lineage(spark, sf_dir)
    return expanded.select(F.col("node").alias("table_name"), F.col("depth").cast("long").alias("depth"))


@query
def upstream_closure_of_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialise(fx.lineage_edges(spark, sf_dir), "edges")
    return lineage.upstream_tables_of_roots(edges, lineage.expanded_tables_of_roots(edges, fx.lineage_roots(spark, sf_dir)))


@query
def upstream_suffix_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.upstream_tables(*_lineage(spark, sf_dir, lineage.suffix_rule))


@query
def lineage_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.reached_edges(*_lineage(spark, sf_dir)).select("child", "parent")


@query
def lineage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.lineage_tables(*_lineage(spark, sf_dir))


@query
def lineage_node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.node_details(*_lineage(spark, sf_dir))


@query
def latest_run_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.latest_runs(fx.table_history(spark, sf_dir))


def _table_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = materialise(lineage.lineage_tables(*_lineage(spark, sf_dir)), "tables")
    return lineage.table_jobs(tables, fx.table_history(spark, sf_dir), fx.job_runs(spark, sf_dir))


@query
def table_job_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_jobs(spark, sf_dir)


@query
def lineage_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.chain_edges(_table_jobs(spark, sf_dir))


@query
def all_table_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over every table that has a writer, not only those upstream of one table."""
    history = fx.table_history(spark, sf_dir)
    tables = materialise(history.select("table_name").distinct(), "tables")
    return lineage.chain_edges(lineage.table_jobs(tables, history, fx.job_runs(spark, sf_dir)))
