"""One job holds half of all rows: its rows must not end up in one task."""

import pytest

from ingestctl.operators import control, taskgraph as tg
from ingestctl.session import configure

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
}


@pytest.fixture
def tuned(spark):
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield configure(spark)
    for key in SMALL:
        spark.conf.unset(key)


def job_params(spark, n):
    """Half of the children belong to job J0, the rest to 200 others."""
    children = spark.range(0, n, 1, 24).selectExpr(
        "concat('J', CASE WHEN id % 2 = 0 THEN 0 ELSE id % 200 END) AS esp_job_id", "'child' AS job_type",
        "'p' AS proj_id", "'d' AS dept_id", "concat('c', id) AS job_id", "'m' AS parent_job_id",
        "id AS invocation_id", "true AS use_runner", "concat('s/', id) AS notebook_path",
        "concat('{\"job_cluster_key\":\"k', id % 50, '\"}') AS cluster_details", "'' AS dependent_libraries",
        "'task' AS parameter_type", "'{}' AS parameter_value", "concat('t', id) AS task_name",
        "'[\"t0\"]' AS depends_on",
    )
    parents = spark.range(200).selectExpr(
        "concat('J', id) AS esp_job_id", "'parent' AS job_type", "'p' AS proj_id", "'d' AS dept_id",
        "concat('J', id) AS job_id", "'m' AS parent_job_id", "0L AS invocation_id", "NULL AS use_runner",
        "NULL AS notebook_path", "NULL AS cluster_details", "NULL AS dependent_libraries",
        "'job' AS parameter_type", "'{}' AS parameter_value", "NULL AS task_name", "NULL AS depends_on",
    )
    return children.unionByName(parents)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_children_of_a_hot_job(tuned):
    params = job_params(tuned, 40_000)
    children = tg.child_rows(params, tg.parent_rows(params))
    rows, plan = final_plan(children.select("esp_job_id", "task_name"))
    assert len(rows) == len(set(rows)) == 40_000
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_dependency(tuned):
    params = job_params(tuned, 40_000)
    children = tg.child_rows(params, tg.parent_rows(params))
    rows, plan = final_plan(tg.valid_dependencies(children))
    assert len(rows) == 20_000 and {row["depends_on"] for row in rows} == {"t0"}
    assert "skew=true" in plan


def test_aggregate_after_a_hot_join(tuned):
    params = job_params(tuned, 40_000)
    children = tg.child_rows(params, tg.parent_rows(params))
    rows, plan = final_plan(tg.cluster_registry(children))
    assert "skew=true" in plan
    wanted = {(f"J{i}", f"k{i % 50}") for i in range(1, 200, 2)} | {("J0", f"k{k}") for k in range(0, 50, 2)}
    assert {(row["esp_job_id"], row["cluster_key"]) for row in rows} == wanted and len(rows) == len(wanted)


def test_parents_of_hot_jobs(tuned):
    params = job_params(tuned, 2_000)
    jobs = tuned.range(0, 40_000, 1, 24).selectExpr(
        "'p' AS proj_id", "'d' AS dept_id", "CASE WHEN id % 2 = 0 THEN 'J0' ELSE concat('x', id) END AS job_id", "id"
    )
    rows, plan = final_plan(control.parent_jobs(jobs, params))
    assert sum(row["parent_job_id"] == "m" for row in rows) == 20_000 and len(rows) == 40_000
    assert "skew=true" in plan


def test_hot_run_is_folded_in_partial_steps(tuned):
    events = tuned.range(0, 30_000, 1, 24).selectExpr(
        "id AS seq", "timestamp_seconds(id) AS ts", "1L AS batch_id", "concat('p', id) AS proj_id", "'d' AS dept_id",
        "'j' AS job_id", "'m' AS parent_job_id", "CASE id % 2 WHEN 0 THEN 'IN_PROGRESS' ELSE 'FAILED' END AS status",
        "CASE id % 2 WHEN 1 THEN concat('e', id) ELSE '' END AS error_message", "'w' AS workflow_id",
        "'r' AS run_id", "concat('u', id) AS run_url",
    )
    view = control.status_view(events)
    (row,) = view.collect()
    assert (row["proj_id"], row["status"], row["error_message"]) == ("p0", "FAILED", "e29999")
