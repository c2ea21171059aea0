"""Job metadata as task tables: parameters, dependencies, leaves, clusters.

Every function works on all jobs at once. ``params`` is the job parameter table; ``parents``
and ``children`` are what ``parent_rows`` and ``child_rows`` make of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ingestctl.functions.text import (
    dependency_names,
    json_list,
    json_map,
    json_object,
    library_kind,
)
from ingestctl.operators.control import COMPLETED, IN_PROGRESS
from ingestctl.operators.ordering import with_previous
from ingestctl.scratch import materialise

JOB = "esp_job_id"

# Names of the control tasks around the children of a job.
BATCH_CHECK = "batch_check"
EXECUTION_CHECK = "job_execution_check"
MARK_IN_PROGRESS = "status_update_in_progress"
MARK_COMPLETED = "status_update_completed"
# Control tasks a child may name as its dependency.
NAMEABLE_CONTROL_TASKS = [BATCH_CHECK, MARK_IN_PROGRESS]

# Parameters every job gets; texts in braces are filled in when a job starts.
RUNTIME_PARAMETERS = {
    "workflow_id": "{{job.id}}",
    "run_id": "{{job.run_id}}",
    "env": "${var.env}",
    "rerun_flag": "N",
}
PARENT_PARAMETERS = ["proj_id", "dept_id", "job_id", "parent_job_id"]


def parent_rows(params: DataFrame) -> DataFrame:
    """The first parent row of each job by invocation, with its payload parsed; a written table."""
    columns = ["proj_id", "dept_id", "job_id", "parent_job_id", "parameter_value", "cluster_details"]
    first = (
        params.where(F.col("job_type") == "parent")
        .groupBy(JOB)
        .agg(F.min_by(F.struct(*columns), F.struct("invocation_id", "job_id")).alias("row"))
        .select(JOB, "row.*")
    )
    return materialise(first, "parents").withColumn("job_params", json_map(F.col("parameter_value")))


def child_rows(params: DataFrame, parents: DataFrame) -> DataFrame:
    """Child rows of the jobs that have a parent, ``invocation_id`` giving their order."""
    children = params.where(F.col("job_type") == "child")
    return children.join(parents.select(JOB), JOB, "left_semi")


def job_details(params: DataFrame, job: str) -> tuple[Row | None, DataFrame | None]:
    """Parent row and ordered children of one job, payloads parsed; (None, None) if it has no parent."""
    mine = params.where(F.col(JOB) == job)
    parents = parent_rows(mine)
    parent = parents.first()
    if parent is None:
        return None, None
    return parent, task_payloads(child_rows(mine, parents)).orderBy("invocation_id", "task_name")


def task_payloads(children: DataFrame) -> DataFrame:
    """Parsed payload columns; a payload that is not JSON is empty and marked invalid."""
    parsed = children.withColumn("payload", json_object(F.col("parameter_value")))
    return parsed.select(
        JOB,
        "task_name",
        "job_id",
        "invocation_id",
        F.col("payload").isNotNull().alias("is_valid"),
        F.coalesce("payload", F.expr("cast(map() as map<string,string>)")).alias("task_params"),
        json_map(F.col("cluster_details")).alias("cluster_info"),
        json_list(F.col("dependent_libraries")).alias("libraries"),
        dependency_names(F.col("depends_on")).alias("depends_on"),
    )


def job_level_parameters(parents: DataFrame) -> DataFrame:
    """(job, name, value, origin): the standard parameters and those of the parent's payload."""
    standard = F.array(
        *[_named(name, F.lit(value)) for name, value in RUNTIME_PARAMETERS.items()],
        _named(JOB, F.col(JOB)),
        *[_named(name, F.col(name)) for name in PARENT_PARAMETERS],
    )
    payload = F.transform(
        F.map_entries("job_params"), lambda entry: _parameter(entry["key"], entry["value"], "payload")
    )
    return parents.select(JOB, F.explode(F.concat(standard, payload)).alias("parameter")).select(
        JOB, "parameter.*"
    )


def task_effective_parameters(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(job, task, name, value): payload entries whose names the job's payload does not set,
    the child's job id, and the real path of a task that goes through the runner."""
    own = children.join(parents.select(JOB, "job_params"), JOB).select(
        JOB,
        "task_name",
        F.map_filter(
            json_map(F.col("parameter_value")),
            lambda name, _: ~F.map_contains_key("job_params", name)
            & (name != "child_job_id")
            & ~((name == "notebook_path") & _uses_runner()),
        ).alias("own"),
        F.map_from_entries(
            F.filter(
                F.array(
                    F.struct(F.lit("child_job_id").alias("key"), F.col("job_id").alias("value")),
                    F.when(
                        _uses_runner(),
                        F.struct(F.lit("notebook_path").alias("key"), F.col("notebook_path").alias("value")),
                    ),
                ),
                lambda entry: entry.isNotNull(),
            )
        ).alias("added"),
    )
    return own.select(JOB, "task_name", F.explode(F.map_concat("own", "added")).alias("name", "value"))


def task_paths(children: DataFrame, runner_path: str) -> DataFrame:
    """The path each task runs: the runner's where the task uses it, else its own."""
    return children.select(
        JOB,
        "task_name",
        F.when(_uses_runner(), F.lit(runner_path)).otherwise(F.col("notebook_path")).alias("run_path"),
        F.when(_uses_runner(), F.col("notebook_path")).alias("notebook_path_parameter"),
    )


def job_tasks(
    children: DataFrame,
    parents: DataFrame,
    control_paths: dict[str, str],
    runner_path: str,
    execution_check: bool = True,
) -> DataFrame:
    """(job, task, run_path, status): the nodes of every job, control tasks included.

    ``control_paths`` gives the path of each control task; ``status`` is what a mark sets.
    """
    marks = {MARK_IN_PROGRESS: IN_PROGRESS, MARK_COMPLETED: COMPLETED}
    controls = [BATCH_CHECK, EXECUTION_CHECK, MARK_IN_PROGRESS, MARK_COMPLETED]
    nodes = F.array(
        *[
            F.struct(
                F.lit(name).alias("task_name"),
                F.lit(control_paths[name]).alias("run_path"),
                F.lit(marks.get(name)).cast("string").alias("status"),
            )
            for name in controls
            if execution_check or name != EXECUTION_CHECK
        ]
    )
    last = children.groupBy(JOB, "task_name").agg(
        F.max_by(F.struct("use_runner", "notebook_path"), F.struct("invocation_id", "job_id")).alias("row")
    )
    own = task_paths(last.select(JOB, "task_name", "row.*"), runner_path)
    return parents.select(JOB, F.explode(nodes).alias("node")).select(JOB, "node.*").unionByName(
        own.select(JOB, "task_name", "run_path", F.lit(None).cast("string").alias("status"))
    )


def named_dependencies(children: DataFrame) -> DataFrame:
    """(job, task, depends_on) for every name in a dependency text, valid or not."""
    return children.select(
        JOB, "task_name", F.explode(dependency_names(F.col("depends_on"))).alias("depends_on")
    )


def checked_dependencies(children: DataFrame) -> DataFrame:
    """``named_dependencies`` with ``is_valid``: the name is a task of the job or a control task."""
    tasks = materialise(children.select(JOB, "task_name").distinct(), "tasks")
    return _mark_valid(named_dependencies(children), tasks)


def valid_dependencies(children: DataFrame) -> DataFrame:
    return checked_dependencies(children).where("is_valid").drop("is_valid").distinct()


def dropped_dependencies(children: DataFrame) -> DataFrame:
    """Names that no task of the job has; they make no edge."""
    return checked_dependencies(children).where(~F.col("is_valid")).drop("is_valid").distinct()


def dependency_table(children: DataFrame) -> DataFrame:
    """Parsed dependencies of every child row, written once because edges and leaves read them
    several times."""
    return materialise(
        children.select(
            JOB, "task_name", "invocation_id", "job_id", dependency_names(F.col("depends_on")).alias("names")
        ),
        "dependencies",
    )


def child_edges(dependencies: DataFrame) -> DataFrame:
    """Valid dependencies of each task's last definition; a task without any follows the start mark."""
    tasks = materialise(
        dependencies.groupBy(JOB, "task_name").agg(
            F.max_by("names", F.struct("invocation_id", "job_id")).alias("names")
        ),
        "tasks",
    )
    named = tasks.select(JOB, "task_name", F.explode("names").alias("depends_on"))
    valid = _mark_valid(named, tasks).where("is_valid").drop("is_valid")
    roots = tasks.select(JOB, "task_name").join(valid, [JOB, "task_name"], "left_anti")
    return valid.unionByName(roots.withColumn("depends_on", F.lit(MARK_IN_PROGRESS)))


def leaf_tasks(dependencies: DataFrame) -> DataFrame:
    """Tasks that no task of the job depends on; all tasks of a job where there is none such."""
    depended = (
        dependencies.select(JOB, F.explode("names").alias("task_name"))
        .distinct()
        .withColumn("is_depended", F.lit(True))
    )
    tasks = dependencies.select(JOB, "task_name").distinct()
    marked = materialise(
        tasks.join(depended, [JOB, "task_name"], "left").select(
            JOB, "task_name", F.col("is_depended").isNull().alias("is_leaf")
        ),
        "marked",
    )
    without_leaf = materialise(
        marked.groupBy(JOB).agg(F.bool_or("is_leaf").alias("has_leaf")).where(~F.col("has_leaf")), "leafless"
    )
    all_of_job = marked.join(without_leaf, JOB, "left_semi")
    return marked.where("is_leaf").unionByName(all_of_job).select(JOB, "task_name")


def task_edges(children: DataFrame, parents: DataFrame, execution_check: bool = True) -> DataFrame:
    """(job, task, depends_on) for the children and the control tasks around them."""
    chain = [BATCH_CHECK, EXECUTION_CHECK, MARK_IN_PROGRESS] if execution_check else [
        BATCH_CHECK,
        MARK_IN_PROGRESS,
    ]
    steps = F.array(
        *[
            F.struct(F.lit(later).alias("task_name"), F.lit(earlier).alias("depends_on"))
            for earlier, later in zip(chain, chain[1:])
        ]
    )
    opening = parents.select(JOB, F.explode(steps).alias("edge")).select(JOB, "edge.*")
    dependencies = dependency_table(children)
    closing = leaf_tasks(dependencies).select(
        JOB, F.lit(MARK_COMPLETED).alias("task_name"), F.col("task_name").alias("depends_on")
    )
    return opening.unionByName(child_edges(dependencies)).unionByName(closing)


def task_levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((job, task, level), (job, task)): when each task can run, and the tasks that never can.

    ``edges`` holds (job, task, depends_on), repeated rows once. Tasks without dependencies have level 0,
    others one more than the largest level they depend on. All jobs are peeled at once, a level a
    round: the tasks that nothing holds back any more are taken off, with the edges to them.
    Those left at the end are in a cycle, or wait for one. A round shuffles the edges to its own tasks and
    the tasks still waiting, so it gets smaller as it goes on.
    """
    edges = materialise(
        edges.where(F.col(JOB).isNotNull() & F.col("task_name").isNotNull() & F.col("depends_on").isNotNull())
        .select(JOB, "task_name", "depends_on")
        .distinct(),
        "edges",
    )
    ends = edges.select(JOB, "task_name", F.lit(1).alias("n")).unionByName(
        edges.select(JOB, F.col("depends_on").alias("task_name"), F.lit(0).alias("n"))
    )
    waiting = materialise(ends.groupBy(JOB, "task_name").agg(F.sum("n").alias("n_left")), "waiting")
    levels: list[DataFrame] = []
    while True:
        ready = materialise(waiting.where("n_left = 0").select(JOB, F.col("task_name").alias("depends_on")), "ready")
        if ready.isEmpty():
            break
        levels.append(ready.select(JOB, F.col("depends_on").alias("task_name"), F.lit(len(levels)).alias("level")))
        freed = edges.join(ready, [JOB, "depends_on"]).groupBy(JOB, "task_name").agg(F.count("*").alias("n_freed"))
        waiting = materialise(
            waiting.where("n_left > 0")
            .join(freed, [JOB, "task_name"], "left")
            .select(JOB, "task_name", (F.col("n_left") - F.coalesce("n_freed", F.lit(0))).alias("n_left")),
            "waiting",
        )
    none = waiting.where("false").select(JOB, "task_name", F.lit(0).alias("level"))
    return reduce(DataFrame.unionByName, levels, none), waiting.select(JOB, "task_name")


def linear_chain(children: DataFrame) -> DataFrame:
    """(job, task, depends_on): explicit dependencies as given, else the preceding task by
    invocation, else the start mark. Children without a path are left out beforehand."""
    order = ["invocation_id", "task_name", "job_id"]
    runnable = children.where(F.col("notebook_path").isNotNull()).select(JOB, *order, "depends_on")
    chained = with_previous(runnable, [JOB], order, "task_name", "previous")
    explicit = dependency_names(F.col("depends_on"))
    implied = F.array(F.coalesce("previous", F.lit(MARK_IN_PROGRESS)))
    return chained.select(
        JOB,
        "task_name",
        F.explode(F.when(F.size(explicit) > 0, explicit).otherwise(implied)).alias("depends_on"),
    )


def linear_closing(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(job, task, depends_on): the completed mark after the last child of the chain, or after the start mark."""
    order = F.struct("invocation_id", "task_name", "job_id")
    last = materialise(
        children.where(F.col("notebook_path").isNotNull()).groupBy(JOB).agg(F.max(order).alias("last")), "last"
    )
    return parents.select(JOB).join(last, JOB, "left").select(
        JOB,
        F.lit(MARK_COMPLETED).alias("task_name"),
        F.coalesce("last.task_name", F.lit(MARK_IN_PROGRESS)).alias("depends_on"),
    )


def cluster_registry(children: DataFrame) -> DataFrame:
    """The first definition of each cluster key of a job, in invocation order."""
    cluster = json_map(F.col("cluster_details"))
    return (
        children.select(
            JOB, "task_name", "invocation_id", "cluster_details", cluster["job_cluster_key"].alias("cluster_key")
        )
        .where(F.col("cluster_key").isNotNull())
        .groupBy(JOB, "cluster_key")
        .agg(
            F.min_by(
                F.struct("task_name", "cluster_details"), F.struct("invocation_id", "task_name")
            ).alias("first")
        )
        .select(
            JOB,
            "cluster_key",
            F.col("first.task_name").alias("defined_by"),
            F.col("first.cluster_details").alias("cluster_details"),
        )
    )


def task_clusters(children: DataFrame, parents: DataFrame, policy: str = "own") -> DataFrame:
    """(job, task, cluster key): ``own`` takes the child's, ``parent`` the parent's for every task.

    A parent's cluster without key is named after the job.
    """
    if policy == "own":
        key = json_map(F.col("cluster_details"))["job_cluster_key"]
        return children.select(JOB, "task_name", key.alias("cluster_key"))
    if policy != "parent":
        raise ValueError(f"unknown policy {policy!r}")
    return children.select(JOB, "task_name").join(parents.select(JOB, _job_cluster().alias("cluster_key")), JOB)


def control_task_clusters(parents: DataFrame, execution_check: bool = True) -> DataFrame:
    """(job, task, cluster key) of the control tasks: the parent's cluster, NULL where it has none."""
    names = [BATCH_CHECK, EXECUTION_CHECK, MARK_IN_PROGRESS, MARK_COMPLETED]
    names = [name for name in names if execution_check or name != EXECUTION_CHECK]
    tasks = F.explode(F.array(*[F.lit(name) for name in names])).alias("task_name")
    return parents.select(JOB, tasks, _job_cluster().alias("cluster_key"))


def job_clusters(children: DataFrame, parents: DataFrame, policy: str = "own") -> DataFrame:
    """(job, cluster key, cluster_details): the clusters that a job has to define under a policy."""
    if policy == "own":
        return cluster_registry(children).select(JOB, "cluster_key", "cluster_details")
    if policy != "parent":
        raise ValueError(f"unknown policy {policy!r}")
    defined = parents.select(JOB, _job_cluster().alias("cluster_key"), "cluster_details")
    return defined.where(F.col("cluster_key").isNotNull())


def _job_cluster() -> Column:
    """The key of a parent's cluster, NULL if the parent has none."""
    info = json_map(F.col("cluster_details"))
    named = F.coalesce(info["job_cluster_key"], F.concat(F.col(JOB), F.lit("_default_cluster")))
    return F.when(F.size(info) > 0, named)


def task_libraries(children: DataFrame) -> DataFrame:
    """(job, task, library, kind, kind_by_suffix), one row per listed library."""
    listed = children.select(
        JOB, "task_name", F.explode(json_list(F.col("dependent_libraries"))).alias("library")
    )
    return listed.select(
        "*",
        library_kind(F.col("library"), "prefix").alias("kind"),
        library_kind(F.col("library"), "suffix").alias("kind_by_suffix"),
    )


def foreach_iterations(tasks: DataFrame, values: Column) -> DataFrame:
    """(job, task, iteration, value): one iteration per element of a list value."""
    return tasks.select(JOB, "task_name", F.explode(values).alias("value")).select(
        JOB,
        "task_name",
        F.concat_ws("_", "task_name", F.lit("iteration"), "value").alias("iteration"),
        "value",
    )


def attribute_children(attributes: DataFrame) -> DataFrame:
    """Children and their sequence from the one-attribute-per-row form of the parameter table."""
    return attributes.where(F.lower("param_name") == "childname").select(
        "proj_id",
        "dept_id",
        "job_id",
        F.col("param_val").alias("name"),
        F.col("invocation_id").try_cast("int").alias("sequence"),
    )


def attribute_value(attributes: DataFrame, param_type: str, param_name: str) -> DataFrame:
    """The first value by invocation number of one attribute, for every job that has it; numberless ids come last."""
    number = F.col("invocation_id").try_cast("bigint")
    return (
        attributes.where(
            (F.lower("param_type") == param_type) & (F.lower("param_name") == param_name)
        )
        .groupBy("proj_id", "dept_id", "job_id")
        .agg(F.min_by("param_val", F.struct(number.isNull(), number, "invocation_id", "param_val")).alias("param_val"))
    )


def _mark_valid(named: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add ``is_valid`` to (job, task, depends_on) rows; ``tasks`` is a written table that has each
    task name of a job once."""
    known = tasks.select(JOB, F.col("task_name").alias("depends_on"), F.lit(True).alias("is_task"))
    is_control = F.col("depends_on").isin(NAMEABLE_CONTROL_TASKS)
    return named.join(known, [JOB, "depends_on"], "left").select(
        JOB,
        "task_name",
        "depends_on",
        (F.coalesce("is_task", F.lit(False)) | is_control).alias("is_valid"),
    )


def _uses_runner() -> Column:
    return F.coalesce(F.col("use_runner"), F.lit(False))


def _parameter(name: Column, value: Column, origin: str) -> Column:
    return F.struct(name.alias("name"), value.alias("value"), F.lit(origin).alias("origin"))


def _named(name: str, value: Column) -> Column:
    return _parameter(F.lit(name), value, "standard")
