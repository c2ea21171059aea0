"""Upstream lineage over an edge table (child, parent) and the jobs that wrote each table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ingestctl.functions.text import labelled, table_name_part
from ingestctl.operators.ordering import with_previous
from ingestctl.scratch import materialise, new_folder, small_frame

#: Levels that one job takes: each costs a join with the edges, while a job costs about a second besides.
LEVELS_PER_JOB = 4


def expanded_tables(
    edges: DataFrame,
    root: str,
    expand: Callable[[Column, Column], Column] | None = None,
    levels_per_job: int = LEVELS_PER_JOB,
) -> DataFrame:
    """(node, depth) of every table whose parents are looked up, the root at depth 0.

    The edges are written once, bucketed by child, so that only frontiers are shuffled.
    ``expand(parent, depth of child)`` limits which parents are looked up in turn; as it may tell
    depths apart, levels are then taken one by one.
    """
    start = small_frame(edges.sparkSession, [(root,)], T.StructType([T.StructField("node", T.StringType())]))
    with bucketed_edges(edges) as by_child:
        return _search(start, by_child, 1 if expand is not None else levels_per_job, expand)


def expanded_tables_of_roots(edges: DataFrame, roots: DataFrame, levels_per_job: int = LEVELS_PER_JOB) -> DataFrame:
    """(root, node, depth) for each root in ``roots`` (column ``root``): itself at depth 0, and all that is upstream.

    All roots are searched at once, as pairs of a root and a table that it reaches: only pairs of the
    result are ever made. A table that most roots reach is one hot key, so edges are a plain
    written table here, whose join adaptive execution can split, as it cannot a bucketed one. Repeated
    roots are one, null roots none, and a root without upstreams reaches itself alone.
    """
    start = roots.where(F.col("root").isNotNull()).select("root").distinct().withColumn("node", F.col("root"))
    known = edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL")
    return _search(start, materialise(known.distinct(), "edges"), levels_per_job)


def _search(
    start: DataFrame, by_child: DataFrame, step: int, expand: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """The rows of ``start`` (node, and a root if it has one) and what they reach, with the smallest depth.

    Breadth-first, ``step`` levels a job: each frontier is joined to the edges, and of what was
    not known before the job the smallest depth is kept. All levels are one table partitioned by
    job: it is the visited set, so a cycle ends by itself.
    """
    spark, known, key = start.sparkSession, new_folder(start.sparkSession, "levels"), start.columns
    owner = [name for name in key if name != "node"]
    schema = ", ".join(f"{name} string" for name in key) + ", depth int, job int"

    def visited() -> DataFrame:
        return spark.read.schema(schema).parquet(known)

    def write_job(nodes: DataFrame, job: int) -> int:
        """How many nodes were found at the last depth, counted while they are written."""
        counted = Observation()
        nodes = nodes.observe(counted, F.count_if(F.col("depth") == job * step).alias("n_last"))
        nodes.withColumn("job", F.lit(job)).write.mode("append").partitionBy("job").parquet(known)
        return counted.get["n_last"]

    n_last, job = write_job(start.withColumn("depth", F.lit(0)), 0), 0
    while n_last:
        last = (F.col("job") == job) & (F.col("depth") == job * step)
        frontier = visited().where(last).select(*owner, F.col("node").alias("child"))
        found = []
        for depth in range(job * step, (job + 1) * step):
            parents = by_child.join(frontier, "child").select(*owner, "parent")
            if expand is not None:
                parents = parents.where(expand(F.col("parent"), F.lit(depth)))
            frontier = parents.select(*owner, F.col("parent").alias("child")).distinct()
            found.append(frontier.select(*owner, F.col("child").alias("node"), F.lit(depth + 1).alias("depth")))
        nearest = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min("depth").alias("depth"))
        job += 1
        n_last = write_job(nearest.join(visited().select(key), key, "left_anti"), job)
    return visited().select(*key, "depth")


@contextmanager
def bucketed_edges(edges: DataFrame) -> Iterator[DataFrame]:
    """Edges as a two-column table bucketed and sorted by child, for as long as the block runs.

    A join on ``child`` then reads it where it lies. It is a table of the current schema for that time, as only the
    catalogue knows of buckets.
    """
    spark = edges.sparkSession
    name, buckets = f"edges_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = edges.select("child", "parent").repartition(buckets, "child")  # one file a bucket
    writer = pairs.write.format("parquet").bucketBy(buckets, "child").sortBy("child")
    writer.option("path", new_folder(spark, "edges")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def suffix_rule(parent: Column, depth: Column) -> Column:
    """Expand ``_wt`` schemas at any depth, ``_tb`` schemas only next to the root."""
    schema = F.lower(table_name_part(parent, 1))
    return schema.contains("_wt") | (schema.contains("_tb") & (depth == 0))


def reached_edges(edges: DataFrame, expanded: DataFrame) -> DataFrame:
    """The edges of the expanded tables: their adjacency as rows, whatever a table's fan-in."""
    return edges.join(expanded.select(F.col("node").alias("child")), "child", "left_semi")


def upstream_tables(edges: DataFrame, expanded: DataFrame) -> DataFrame:
    """Distinct upstream tables; the root is one of them only if a cycle leads back to it."""
    return reached_edges(edges, expanded).select(F.col("parent").alias("table_name")).distinct()


def upstream_tables_of_roots(edges: DataFrame, expanded: DataFrame) -> DataFrame:
    """(root, table_name): the distinct upstream tables of each root, itself only where a cycle leads back to it.

    ``expanded`` is what ``expanded_tables_of_roots`` found over these edges.
    """
    # A table that was found below depth 0 is upstream by that; only a way back to the root is still to be looked for.
    roots = expanded.where("depth = 0").select(F.col("root").alias("parent"))
    back = edges.select("child", "parent")
    back = back.join(roots, "parent", "left_semi").unionByName(back.where("parent IS NULL"))
    returns = expanded.select("root", F.col("node").alias("child")).join(materialise(back.distinct(), "back"), "child")
    returns = returns.where("parent IS NULL OR parent = root").select("root", F.col("parent").alias("table_name"))
    found = expanded.where("depth > 0").select("root", F.col("node").alias("table_name"))
    return found.unionByName(returns.distinct())


def lineage_tables(edges: DataFrame, expanded: DataFrame) -> DataFrame:
    """Tables that have upstreams, together with those upstreams."""
    reached = reached_edges(edges, expanded)
    ends = F.explode(F.array("child", "parent")).alias("table_name")
    return reached.select(ends).distinct()


def node_details(edges: DataFrame, expanded: DataFrame) -> DataFrame:
    """Name parts and table type of each upstream table."""
    details = (
        reached_edges(edges, expanded)
        .groupBy(F.col("parent").alias("table_name"))
        .agg(F.max("table_type").alias("table_type"))
    )
    return details.select(
        "table_name",
        table_name_part(F.col("table_name"), 0).alias("catalog_name"),
        table_name_part(F.col("table_name"), 1).alias("schema_name"),
        table_name_part(F.col("table_name"), 2).alias("name"),
        "table_type",
    )


def latest_runs(history: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """The run that wrote the highest version of each table; of runs with the same version the largest id.

    The versions are folded in a hash map, and the few texts that count are looked up afterwards.
    ``tables`` (table_name) limits the tables: the folded rows, one a table, are held against it, not the history.
    """
    newest = history.groupBy("table_name").agg(F.max("version").alias("version"))
    if tables is not None:
        newest = newest.join(tables, "table_name", "left_semi")
    newest = materialise(newest, "newest")
    return history.join(newest, ["table_name", "version"]).groupBy("table_name").agg(F.max("run_id").alias("run_id"))


def run_jobs(runs: DataFrame, parameter: str = "esp_job_id") -> DataFrame:
    """The job of each run: from its first task's parameters, else from the run's own. A repeated run is one."""
    first_task = F.get("tasks", F.lit(0))["notebook_task"]["base_parameters"]
    job = F.coalesce(first_task[parameter], F.col("job_parameters")[parameter])
    return runs.select("run_id", job.alias(parameter)).groupBy("run_id").agg(F.max(parameter).alias(parameter))


def table_jobs(tables: DataFrame, history: DataFrame, runs: DataFrame) -> DataFrame:
    """(table, job): the job that last wrote each table, NULL where it is not known.

    ``tables`` is a written table with each name once.
    """
    written = materialise(tables.join(latest_runs(history, tables), "table_name", "left"), "written")
    # tables without a run would all meet in one task
    known = written.where(F.col("run_id").isNotNull())
    # of all runs only those that some table was last written by are grouped
    asked = materialise(known.select("run_id").distinct(), "asked")
    known = known.join(run_jobs(runs.join(asked, "run_id", "left_semi")), "run_id", "left")
    unknown = written.where(F.col("run_id").isNull()).withColumn("esp_job_id", F.lit(None).cast("string"))
    columns = ["table_name", "esp_job_id"]
    return known.select(columns).unionByName(unknown.select(columns))


def chain_edges(table_jobs: DataFrame) -> DataFrame:
    """(previous_label, label) of consecutive rows in table order."""
    nodes = table_jobs.select("table_name", labelled(F.col("table_name"), F.col("esp_job_id")).alias("label"))
    chained = with_previous(nodes, [], ["table_name"], "label", "previous_label")
    return chained.where(F.col("previous_label").isNotNull()).select("previous_label", "label")
