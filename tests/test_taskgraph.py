import json

import pytest
from pyspark.sql import functions as F

from ingestctl.functions import text
from ingestctl.operators import taskgraph as tg
from tests.conftest import rows

PARAMS_DDL = (
    "esp_job_id string, job_type string, proj_id string, dept_id string, job_id string, parent_job_id string, "
    "invocation_id int, use_runner boolean, notebook_path string, cluster_details string, "
    "dependent_libraries string, parameter_type string, parameter_value string, task_name string, depends_on string"
)


def parent(job, payload="{}", cluster=None, invocation=0):
    return (job, "parent", "p", "d", job, job, invocation, None, None, cluster, None, "job", payload, None, None)


def child(job, invocation, task, depends_on=None, **more):
    return (
        job, "child", "p", "d", more.get("job_id", f"{job}_{invocation}"), job, invocation, more.get("runner", True),
        more.get("path", f"scripts/{task}"), more.get("cluster"), more.get("libraries"), "task",
        more.get("payload", "{}"), task, depends_on,
    )


def graph(spark, *params):
    df = spark.createDataFrame(list(params), PARAMS_DDL)
    parents = tg.parent_rows(df)
    return parents, tg.child_rows(df, parents)


def edges(spark, *params, execution_check=False):
    parents, children = graph(spark, *params)
    found = tg.task_edges(children, parents, execution_check)
    return {tuple(row) for row in found.select("task_name", "depends_on").collect()}


START = ("status_update_in_progress", "batch_check")
IN, DONE = "status_update_in_progress", "status_update_completed"


# The edges of four known jobs.
def test_golden_linear(spark):
    assert edges(spark, parent("J"), child("J", 1, "s1"), child("J", 2, "s2", "[s1]")) == {
        START, ("s1", IN), ("s2", "s1"), (DONE, "s2"),
    }


def test_golden_diamond(spark):
    found = edges(
        spark, parent("J"), child("J", 1, "s1"), child("J", 2, "s2", "[s1]"), child("J", 1, "s3"),
        child("J", 3, "s4", "[s2, s3]"),
    )
    assert found == {
        START, ("s3", IN), ("s1", IN), ("s2", "s1"), ("s4", "s2"), ("s4", "s3"), (DONE, "s4"),
    }


def test_golden_single(spark):
    assert edges(spark, parent("J"), child("J", 1, "py0", runner=False)) == {START, ("py0", IN), (DONE, "py0")}


def test_golden_load_then_script(spark):
    found = edges(spark, parent("J"), child("J", 1, "load"), child("J", 2, "s1", '["load"]'))
    assert found == {START, ("load", IN), ("s1", "load"), (DONE, "s1")}


def test_execution_check_goes_in_between(spark):
    found = edges(spark, parent("J"), child("J", 1, "a"), execution_check=True)
    assert found == {
        ("job_execution_check", "batch_check"), (IN, "job_execution_check"), ("a", IN), (DONE, "a"),
    }


def test_task_defined_twice_last_definition_wins(spark):
    """The second definition depends on itself, so no task is a leaf and all of them end the job."""
    found = edges(
        spark, parent("J"), child("J", 1, "s1"), child("J", 2, "s2", "[s1]"), child("J", 1, "s3", job_id="J_3"),
        child("J", 3, "s3", "[s2, s3]", job_id="J_4"),
    )
    assert found == {
        START, ("s1", IN), ("s2", "s1"), ("s3", "s2"), ("s3", "s3"),
        (DONE, "s1"), (DONE, "s2"), (DONE, "s3"),
    }


def test_cycle_falls_back_to_all_tasks(spark):
    found = edges(spark, parent("J"), child("J", 1, "a", '["b"]'), child("J", 2, "b", '["a"]'))
    assert found == {START, ("a", "b"), ("b", "a"), (DONE, "a"), (DONE, "b")}


def test_names_of_other_jobs_and_unknown_names_are_dropped(spark):
    params = [parent("J"), child("J", 1, "a", '["x", "gone", "batch_check"]'), parent("K"), child("K", 1, "x")]
    parents, children = graph(spark, *params)
    assert rows(tg.valid_dependencies(children)) == [("J", "a", "batch_check")]
    assert rows(tg.dropped_dependencies(children)) == [("J", "a", "gone"), ("J", "a", "x")]


def test_job_without_parent_has_no_graph(spark):
    assert edges(spark, child("J", 1, "a")) == set()
    assert edges(spark, parent("J")) == {START}


@pytest.mark.parametrize(
    "value, names",
    [
        ('["a", "b"]', ["a", "b"]),
        ('[{"task_key": "a"}, "b", {"other": 1}]', ["a", "b"]),
        ("[a]", ["a"]),
        ("['a', \"b\" , c]", ["a", "b", "c"]),
        ("a, b", ["a", "b"]),
        ('"a"', ["a"]),
        ('["a", b]', ["a", "b"]),
        ('["a", "a"]', ["a"]),
        ("[1, 2]", ["1", "2"]),
        ('["a"] b', ["a] b"]),
        ("[]", []),
        ("[ , ]", []),
        ("", []),
        (None, []),
    ],
)
def test_dependency_names(spark, value, names):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.dependency_names(F.col("v")).alias("n")).first()["n"] == names


@pytest.mark.parametrize(
    "value", ['{"a": "x", "n": 1}', '{"a": 1} more', ' {"a": 1} \n', '{"x": proj_id}', "[1]", "", None, "{}", '{"a": {"b": 2}}', "{'a': 1}"]
)
def test_json_map_like_json_loads(spark, value):
    try:
        wanted = json.loads(value) if value else {}
        wanted = wanted if isinstance(wanted, dict) else {}
    except json.JSONDecodeError:
        wanted = {}
    wanted = {
        k: v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for k, v in wanted.items()
    }
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.json_map(F.col("v")).alias("m")).first()["m"] == wanted


def test_parameters(spark):
    parents, children = graph(
        spark,
        parent("J", '{"env": "dev", "schema_name": "top"}'),
        parent("J", '{"late": "1"}', invocation=3),
        child("J", 1, "a", payload='{"schema_name": "own", "child_job_id": "mine", "k": "v"}'),
        child("J", 2, "b", runner=None, payload='{"notebook_path": "kept"}'),
    )
    job = {(r["name"], r["value"], r["origin"]) for r in tg.job_level_parameters(parents).collect()}
    assert ("env", "${var.env}", "standard") in job and ("env", "dev", "payload") in job
    assert ("rerun_flag", "N", "standard") in job and len(job) == 11
    assert rows(tg.task_effective_parameters(children, parents)) == sorted([
        ("J", "a", "k", "v"), ("J", "a", "child_job_id", "J_1"), ("J", "a", "notebook_path", "scripts/a"),
        ("J", "b", "notebook_path", "kept"), ("J", "b", "child_job_id", "J_2"),
    ])
    assert rows(tg.task_paths(children, "run/main")) == [
        ("J", "a", "run/main", "scripts/a"), ("J", "b", "scripts/b", None),
    ]


def test_job_details(spark):
    params = spark.createDataFrame(
        [parent("J", '{"env": "dev"}'), child("J", 2, "b"), child("J", 1, "a"), child("K", 1, "x")], PARAMS_DDL
    )
    found, children = tg.job_details(params, "J")
    assert found["job_params"] == {"env": "dev"}
    assert [row["task_name"] for row in children.collect()] == ["a", "b"]
    assert tg.job_details(params, "K") == (None, None)


def test_job_tasks(spark):
    parents, children = graph(
        spark, parent("J"), child("J", 1, "a", path="old"), child("J", 2, "a", path="new", runner=False)
    )
    paths = {name: f"c/{name}" for name in [tg.BATCH_CHECK, tg.EXECUTION_CHECK, IN, DONE]}
    assert rows(tg.job_tasks(children, parents, paths, "run", execution_check=False)) == [
        ("J", "a", "new", None), ("J", "batch_check", "c/batch_check", None),
        ("J", DONE, f"c/{DONE}", "COMPLETED"), ("J", IN, f"c/{IN}", "IN_PROGRESS"),
    ]


def test_linear_chain(spark):
    _, children = graph(
        spark, parent("J"), child("J", 1, "a"), child("J", 2, "skipped", path=None), child("J", 3, "c"),
        child("J", 4, "d", '["a"]'), child("J", 5, "e", ""),
    )
    assert rows(tg.linear_chain(children)) == [
        ("J", "a", IN), ("J", "c", "a"), ("J", "d", "a"), ("J", "e", "d"),
    ]


def test_clusters(spark):
    first, second = '{"job_cluster_key": "c", "n": 1}', '{"job_cluster_key": "c", "n": 2}'
    parents, children = graph(
        spark, parent("J", cluster='{"n": 3}'), child("J", 2, "b", cluster=second), child("J", 1, "a", cluster=first),
        child("J", 3, "none"), parent("K"), child("K", 1, "x", cluster=second),
    )
    assert rows(tg.cluster_registry(children)) == [("J", "c", "a", first), ("K", "c", "x", second)]
    assert rows(tg.task_clusters(children, parents)) == [
        ("J", "a", "c"), ("J", "b", "c"), ("J", "none", None), ("K", "x", "c"),
    ]
    assert rows(tg.task_clusters(children, parents, "parent")) == [
        ("J", "a", "J_default_cluster"), ("J", "b", "J_default_cluster"), ("J", "none", "J_default_cluster"),
        ("K", "x", None),
    ]


def test_libraries(spark):
    _, children = graph(spark, parent("J"), child("J", 1, "a", libraries='["dbfs:/x.jar", "p.whl"]'), child("J", 2, "b"))
    assert rows(tg.task_libraries(children)) == [
        ("J", "a", "dbfs:/x.jar", "jar", "jar"), ("J", "a", "p.whl", "pypi", "whl"),
    ]


def test_foreach(spark):
    tasks = spark.createDataFrame([("J", "load", ["a", "b"]), ("J", "none", [])], "esp_job_id string, task_name string, v array<string>")
    assert rows(tg.foreach_iterations(tasks, F.col("v"))) == [
        ("J", "load", "load_iteration_a", "a"), ("J", "load", "load_iteration_b", "b"),
    ]


def test_payloads_must_be_one_whole_object(spark):
    from ingestctl.functions.text import json_list, json_map, json_object

    texts = ['{"a":1,"b":2,"a":3}', '{"a":1} trailing }', '{"a":1}, {"b":2}', "{}", "null", "", None, '{"a":null}', "[1]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["m"] for r in frame.select("t", json_object(F.col("t")).alias("m")).collect()}
    assert got == {
        '{"a":1,"b":2,"a":3}': {"a": "3", "b": "2"},
        '{"a":1} trailing }': None,
        '{"a":1}, {"b":2}': None,
        "{}": {},
        "null": None,
        "": None,
        None: None,
        '{"a":null}': {"a": None},
        "[1]": None,
    }
    assert frame.select(json_map(F.col("t")).alias("m")).where("m is null").count() == 0
    lists = {'["a","b"]': ["a", "b"], '["a"] x ]': [], "[]": [], '["a"],["b"]': [], None: []}
    frame = spark.createDataFrame([(t,) for t in lists], "t string")
    assert {r[0]: r[1] for r in frame.select("t", json_list(F.col("t"))).collect()} == lists


def test_text_after_the_value_is_refused(spark):
    from ingestctl.functions.text import json_list, json_object

    texts = ['{"a":1}] junk', '{"a":1}]]', '{"a":1}]}', '{"a":1}}', '{"a":1}}]', '["x"]] y', '["x"]}', '["x"]]}', '["x"]}}', "1", "[[1]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert frame.where(json_object(F.col("t")).isNotNull() | (F.size(json_list(F.col("t"))) > 0)).collect() == []


def test_repeated_keys_among_many(spark):
    from ingestctl.functions.text import json_object

    entries = [(f"k{i % 37}", str(i)) for i in range(100)]
    text = "{" + ",".join(f'"{k}":"{v}"' for k, v in entries) + "}"
    assert spark.createDataFrame([(text,)], "t string").select(json_object(F.col("t"))).first()[0] == dict(entries)


def test_attribute_ids_are_compared_as_numbers(spark):
    schema = "proj_id string, dept_id string, job_id string, param_type string, param_name string, param_val string, invocation_id string"
    rows_ = [("p", "d", "j", "T", "N", v, i) for v, i in [("ten", "10"), ("nine", "9"), ("odd", "x")]]
    frame = spark.createDataFrame(rows_ + [("p", "d", "j", "T", "ChildName", "c", "x")], schema)
    assert tg.attribute_value(frame, "t", "n").first()["param_val"] == "nine"
    assert tg.attribute_children(frame).first()["sequence"] is None
