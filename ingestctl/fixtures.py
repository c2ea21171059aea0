"""Landing files, configuration rows and control tables derived from the test tables.

Every frame here is a scan of a given table with columns computed row by row, or a grouped
minimum joined back; nothing is sorted or numbered within a group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingestctl.scratch import materialise, new_folder

# The columns of the configuration table.
CONFIG_DDL = (
    "project_id string, dept_id string, job_id string, Entity_Name string, Src_Path string, "
    "File_Pattern string, Delimiter string, Header_Flag string, Header string, Skiplines int, "
    "Fixed_Length_Position string, Target_Catalog string, Target_Schema string, Raw_Catalog string, "
    "Raw_Schema string, Raw_Ingestion_Flag string, Transformations string, Table_Mode string, "
    "Partition_Column string, Archival_Path string, Log_Path string, Audit_Catalog string, "
    "Audit_Schema string, Audit_Table string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_database(spark: SparkSession) -> str:
    """An empty schema whose tables lie in the shared folder."""
    name = f"ictl_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_folder(spark, 'db')}'")
    return name


def create_like(spark: SparkSession, target: str, df: DataFrame) -> None:
    """An empty table with the columns and types of ``df``."""
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema)
    spark.sql(f"CREATE TABLE {target} ({columns}) USING parquet")


def delimited_line(df: DataFrame, delimiter: str) -> Column:
    texts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in df.columns]
    return F.concat_ws(delimiter, *texts)


def write_landing(
    df: DataFrame, folder: str, line: Column, header_lines: int = 0, by: str | None = None
) -> str:
    """Write one line per row; each file starts with ``header_lines`` lines that are no data.

    A task writes one file, so the header goes in front of a task's first row. ``by`` gives a
    subfolder per value of a column, without header lines.
    """
    if by is not None:
        df.select(line.alias("value"), by).write.partitionBy(by).text(folder)
        return folder
    header = "".join(f"# header {i + 1}\n" for i in range(header_lines))
    first_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    with_header = F.when(first_in_task, F.concat(F.lit(header), line)).otherwise(line)
    df.select(with_header.alias("value")).write.text(folder)
    return folder


def config_row(database: str, entity: str, folder: str, **changes) -> dict:
    """One configuration row: two header lines, ``|`` as delimiter, append, audit in the same schema."""
    row = {
        "project_id": "p1", "dept_id": "d1", "job_id": "load", "Entity_Name": entity,
        "Src_Path": folder, "File_Pattern": "*.txt", "Delimiter": "|", "Header_Flag": "Y",
        "Header": "", "Skiplines": 2, "Fixed_Length_Position": None, "Target_Catalog": None,
        "Target_Schema": database, "Raw_Catalog": None, "Raw_Schema": database,
        "Raw_Ingestion_Flag": "N", "Transformations": "", "Table_Mode": "append",
        "Partition_Column": None, "Archival_Path": None, "Log_Path": None, "Audit_Catalog": None,
        "Audit_Schema": database, "Audit_Table": "ingestion_audit",
    }
    row.update(changes)
    return row


def config_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [part.split()[0] for part in CONFIG_DDL.split(", ")]
    return spark.createDataFrame([tuple(row[name] for name in names) for row in rows], CONFIG_DDL)


def entity_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large configuration table with repeated entities, from part."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('p', p_partkey % 3) AS project_id",
        "concat('d', p_partkey % 2) AS dept_id",
        "concat('j', p_partkey % 5) AS job_id",
        "concat(p_name, ' ', p_type) AS Entity_Name",
        "concat('/landing/', p_brand, '/') AS Src_Path",
        "concat('part', p_partkey, '_*.dat') AS File_Pattern",
        "CASE p_size % 3 WHEN 0 THEN '|' WHEN 1 THEN 'x01' ELSE '' END AS Delimiter",
        "p_size AS Skiplines",
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS seq",
        "ts",
        "user_id % 10 AS batch_id",
        "concat('p', event_id % 3) AS proj_id",
        "'d0' AS dept_id",
        "concat('job', user_id % 7) AS job_id",
        "concat('parent', event_id % 4) AS parent_job_id",
        """CASE WHEN event_type IN ('signup', 'view') THEN 'IN_PROGRESS'
                WHEN event_type IN ('purchase', 'click') THEN 'COMPLETED' ELSE 'FAILED' END AS status""",
        "CASE WHEN event_type = 'error' THEN concat('e', event_id) ELSE '' END AS error_message",
        "concat('w', event_id % 5) AS workflow_id",
        "cast(event_id % 40 AS string) AS run_id",
        "concat('run/', event_id) AS run_url",
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS batch_id",
        """CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'OPEN'
                WHEN o_orderstatus = 'O' THEN 'open' ELSE 'Closed' END AS status""",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct jobs per batch; job7 never runs in the events."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "user_id % 10 AS batch_id",
            "concat('p', event_id % 3) AS proj_id",
            "'d0' AS dept_id",
            "concat('job', event_id % 8) AS job_id",
        )
        .distinct()
    )


def job_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job parameter table: a parent per customer, a child per order.

    Every 11th customer's row is a draft, so its job has no parent; some customers have two rows. Every 17th order has a second, later
    definition. Dependencies come as JSON names, JSON objects, list text that is not JSON,
    unknown names and nothing; some payloads are not JSON.
    """
    parent = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS c",
        "explode(CASE WHEN c_custkey % 5 = 0 THEN array(0L, 1L) ELSE array(0L) END) AS invocation_id",
    )
    parents = parent.selectExpr(
        "concat('J', c) AS esp_job_id",
        "CASE WHEN c % 11 = 0 THEN 'draft' ELSE 'parent' END AS job_type",
        "concat('p', c % 3) AS proj_id",
        "concat('d', c % 2) AS dept_id",
        "concat(CASE WHEN c % 11 = 0 THEN 'draft' WHEN invocation_id = 0 THEN 'job' ELSE 'late' END, c) AS job_id",
        "concat('job', c) AS parent_job_id",
        "invocation_id",
        "cast(NULL AS boolean) AS use_runner",
        "cast(NULL AS string) AS notebook_path",
        """CASE c % 4 WHEN 0 THEN concat('{"job_cluster_key":"jc', c % 5, '","new_cluster":{}}')
                     WHEN 1 THEN '{"new_cluster":{"num_workers":2}}' END AS cluster_details""",
        "cast(NULL AS string) AS dependent_libraries",
        "'job' AS parameter_type",
        """CASE WHEN invocation_id = 1 THEN '{"late":"1"}'
                WHEN c % 7 = 0 THEN '{"env": env}'
                WHEN c % 3 = 0 THEN '{"env":"dev"}'
                WHEN c % 3 = 1 THEN '{"env":"dev","catalog_name":"top"}'
                ELSE '{"env":"dev","schema_name":"top"}' END AS parameter_value""",
        "cast(NULL AS string) AS task_name",
        "cast(NULL AS string) AS depends_on",
    )
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    ends = materialise(orders.groupBy("c").agg(F.min("k").alias("f"), F.max("k").alias("l")), "ends")
    defined = orders.join(ends, "c").selectExpr(
        "*", "explode(CASE WHEN k % 17 = 0 THEN array(0L, 1L) ELSE array(0L) END) AS again"
    )
    children = defined.selectExpr(
        "concat('J', c) AS esp_job_id",
        "'child' AS job_type",
        "concat('p', c % 3) AS proj_id",
        "concat('d', c % 2) AS dept_id",
        "concat('job', c, '_', k, CASE again WHEN 1 THEN '_b' ELSE '' END) AS job_id",
        "concat('job', c) AS parent_job_id",
        "k div 2 + again AS invocation_id",
        "CASE WHEN k % 2 = 0 THEN true WHEN k % 3 = 0 THEN NULL ELSE false END AS use_runner",
        "CASE WHEN k % 13 <> 0 THEN concat('scripts/t', k) END AS notebook_path",
        """CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN ''
           ELSE concat('{"job_cluster_key":"c', k % 3, '","new_cluster":{"num_workers":', k % 4, '}}')
           END AS cluster_details""",
        """CASE k % 3 WHEN 0 THEN '["dbfs:/x.jar","numpy"]' WHEN 1 THEN '["pkg.whl"]' ELSE ''
           END AS dependent_libraries""",
        "'task' AS parameter_type",
        """CASE k % 40 WHEN 0 THEN '{"catalog_name": dev}'
                       WHEN 10 THEN '{"catalog_name":"dev"}] junk'
                       WHEN 20 THEN '{"catalog_name":"dev"}]]'
                       WHEN 30 THEN '["dev"]] y'
           ELSE concat('{"catalog_name":"dev","schema_name":"s', k % 5, '"}') END AS parameter_value""",
        "concat('t', k) AS task_name",
        """CASE WHEN again = 1 THEN concat('["t', l, '"]')
                WHEN k % 6 = 0 THEN ''
                WHEN k % 6 = 1 THEN concat('["t', f, '"]')
                WHEN k % 6 = 2 THEN concat("['t", f, "', t", l, "]")
                WHEN k % 6 = 3 THEN '["nope"]'
                WHEN k % 6 = 4 THEN concat('[{"task_key":"t', l, '"}]')
                ELSE concat('["batch_check", "t', f, '"]') END AS depends_on""",
    )
    return parents.unionByName(children)


def job_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-attribute-per-row form of the parameter table."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('p', o_custkey % 3) AS proj_id",
        "concat('d', o_custkey % 2) AS dept_id",
        "concat('job', o_custkey) AS job_id",
        "cast(o_orderkey AS string) AS invocation_id",
        """inline(array_compact(array(
             struct('job' AS param_type,
                    CASE o_orderkey % 2 WHEN 0 THEN 'ChildName' ELSE 'CHILDNAME' END AS param_name,
                    concat('t', o_orderkey) AS param_val),
             CASE WHEN o_orderkey % 13 <> 0 THEN
                  struct('Notebook' AS param_type, 'Path' AS param_name,
                         concat('scripts/t', o_orderkey) AS param_val) END,
             struct('task' AS param_type, 'Catalog' AS param_name, 'dev' AS param_val))))
             AS (param_type, param_name, param_val)""",
    )


def loop_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with a JSON list of table names to load."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('J', o_custkey) AS esp_job_id",
        "concat('t', o_orderkey) AS task_name",
        """concat('["src', o_orderkey % 7, '","src', 10 + o_orderkey % 5, '"]') AS loop_values""",
    )


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer as text; both numbers are malformed for every 7th key."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey AS string) AS c_custkey",
        "concat(CASE c_custkey % 7 WHEN 0 THEN 'x' ELSE '' END, c_nationkey) AS c_nationkey",
        "concat(CASE c_custkey % 7 WHEN 0 THEN 'x' ELSE '' END, c_acctbal) AS c_acctbal",
    )


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat_ws('|', slice(array(cast(c_custkey AS string), 'b', 'c', 'd', 'e'), 1, cast(1 + c_custkey % 5 AS int))) AS value"
    )


def task_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, task, depends_on) of seven jobs, from part: task i waits for tasks i/2 and i/3, so there are about as
    many levels as i has binary digits, and some wait for the task that waits for them."""
    numbered = table(spark, sf_dir, "part").selectExpr("p_partkey % 7 AS j", "p_partkey div 7 AS i").where("i > 0")
    return numbered.selectExpr(
        "concat('J', j) AS esp_job_id",
        "concat('t', i) AS task_name",
        """explode(transform(filter(array(i div 2, i div 3, CASE WHEN i % 53 = 52 THEN 2 * i END), n -> n > 0),
                             n -> concat('t', n))) AS depends_on""",
    )


_TABLE_NAME = "concat('dev.', CASE WHEN {0} % 2 = 0 THEN 'stg_wt' ELSE 'mart_tb' END, '.t', {0})"


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, table_type of the parent), from part.

    Table n is made from tables 2n and 2n + 1, so levels double in width and the first table
    reaches all others; every eleventh also leads back to a smaller one, which makes cycles.
    """
    numbered = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS child_no",
        """explode(filter(array(
             2 * p_partkey, 2 * p_partkey + 1,
             CASE WHEN p_partkey % 11 = 0 THEN p_partkey div 3 END),
             n -> n IS NOT NULL AND n <> p_partkey)) AS parent_no""",
    )
    return (
        numbered.distinct()
        .selectExpr(
            _TABLE_NAME.format("child_no") + " AS child",
            _TABLE_NAME.format("parent_no") + " AS parent",
            "CASE parent_no % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' END AS table_type",
        )
    )


def lineage_root(spark: SparkSession, sf_dir: str) -> str:
    """Where to start: the table with the smallest number above 0."""
    first = table(spark, sf_dir, "part").where("p_partkey > 0").agg(F.min("p_partkey").alias("n"))
    return first.selectExpr(_TABLE_NAME.format("n") + " AS root").first()["root"]


def lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root for each nation."""
    return table(spark, sf_dir, "nation").selectExpr(_TABLE_NAME.format("(n_nationkey + 1)") + " AS root")


def table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        _TABLE_NAME.format("l_partkey") + " AS table_name",
        "l_orderkey * 10 + l_linenumber AS version",
        "cast(l_orderkey AS string) AS run_id",
    )


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose job id is a task parameter, a run parameter, or missing."""
    return table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey AS string) AS run_id",
        """array(named_struct('notebook_task', named_struct('base_parameters',
             CASE o_orderkey % 3 WHEN 1 THEN map('esp_job_id', concat('J', o_custkey))
                                 ELSE map('other', 'x') END))) AS tasks""",
        """CASE o_orderkey % 3 WHEN 2 THEN map('esp_job_id', concat('K', o_custkey))
                               ELSE map('other', 'x') END AS job_parameters""",
    )
