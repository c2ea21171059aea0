"""Rules counted within a load, and the order of tasks."""

import random

import pytest
from pyspark.sql import functions as F

from ingestctl.operators import rules as R
from ingestctl.operators import taskgraph
from tests.conftest import rows
from tests.test_ingestion import audit, entity, put, run

RULES = "entity_name string, rule_name string, condition string, max_failed_share double"


def rule_table(spark, *listed):
    return spark.createDataFrame(list(listed), RULES)


def results(spark, database):
    told = spark.table(f"{database}.ingestion_audit_rules")
    return rows(told.select("entity_name", "rule_name", "n_rows", "n_failed", "passed"))


def test_a_broken_rule_loads_nothing_and_can_be_mended(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "h\n1|x\n|y\n3|z\n4|\n")
    configured = [entity(database, folder, "e"), entity(database, folder, "other")]
    strict = rule_table(
        spark, ("e", "has a", "a IS NOT NULL AND a <> ''", 0.1), ("e", "some value", R.not_all_null(["a", "b"]), None)
    )
    done = run(spark, *configured, rules=strict)
    assert done["other"]["status"] == "SUCCESS" and done["e"]["status"] == "FAILURE"
    assert "has a: 1 of 4 rows" in done["e"]["error_message"]
    assert spark.table(f"{database}.e").count() == 0
    assert results(spark, database) == [("e", "has a", 4, 1, False), ("e", "some value", 4, 0, True)]
    lenient = rule_table(spark, ("e", "has a", "a IS NOT NULL AND a <> ''", 0.25))
    assert run(spark, *configured, rules=lenient)["e"]["file_row_count"] == 4
    assert spark.table(f"{database}.e").count() == 4
    assert [row["status"] for row in audit(spark, database) if row["entity_name"] == "e"] == ["FAILURE", "SUCCESS"]


def test_a_step_that_breaks_a_rule_leaves_the_steps_before(spark, database, tmp_path):
    for i, line in enumerate(["1|x", "|x", "3|x"]):
        put(tmp_path, f"f{i}.txt", f"h\n{line}\n", 1_700_000_000 + i)
    strict = rule_table(spark, ("e", "has a", "a <> ''", 0.0))
    assert run(spark, entity(database, tmp_path), max_files_per_step=1, rules=strict)["e"]["status"] == "FAILURE"
    assert rows(spark.table(f"{database}.e")) == [("1", "x")]


@pytest.mark.parametrize("condition", ["no_such_column > 1", "a >", "count(a) > 1"])
def test_conditions_that_do_not_fit(spark, database, tmp_path, condition):
    folder = put(tmp_path, "a.txt", "h\n1|x\n")
    bad = rule_table(spark, ("e", "bad", condition, None))
    assert run(spark, entity(database, folder), rules=bad)["e"]["status"] == "FAILURE"
    assert run(spark, entity(database, folder))["e"]["status"] == "SUCCESS"


def test_rows_are_read_once(spark):
    frame = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    found = R.checked(frame, [R.Rule("x", R.not_all_null(["a", "b"]), 0.5), R.Rule("y", "a > 0", 0.4)])
    found.rows.collect()
    assert [(rule.name, n, failed, passed) for rule, n, failed, passed in found.results()] == [
        ("x", 2, 1, True),
        ("y", 2, 1, False),
    ]
    with pytest.raises(R.RulesBroken, match="y: 1 of 2"):
        R.require_passed(found.results())


def brute_levels(edges):
    deps = {}
    for job, task, on in edges:
        deps.setdefault((job, task), set()).add((job, on))
        deps.setdefault((job, on), set())
    levels = {}
    while ready := {t for t, on in deps.items() if t not in levels and on <= set(levels)}:
        levels |= {t: max((levels[d] + 1 for d in deps[t]), default=0) for t in ready}
    return levels, set(deps) - set(levels)


@pytest.mark.parametrize("seed", [1, 2])
def test_levels(spark, seed):
    rng = random.Random(seed)
    edges = [(f"J{rng.randrange(3)}", f"t{rng.randrange(25)}", f"t{rng.randrange(25)}") for _ in range(40)]
    edges += [(j, t, f"{t}0") for j, t, _ in edges[:3]] + edges[:5] + [("J9", "a", "a"), ("J9", "b", "a"), (None, "x", "y"), ("J9", None, "y")]
    frame = spark.createDataFrame(edges, "esp_job_id string, task_name string, depends_on string")
    levels, left = taskgraph.task_levels(frame)
    wanted = brute_levels([e for e in edges if None not in e])
    assert {(r[0], r[1]): r[2] for r in levels.collect()} == wanted[0]
    assert {tuple(r) for r in left.collect()} == wanted[1] and ("J9", "b") in wanted[1]
    nothing = taskgraph.task_levels(frame.where(F.lit(False)))
    assert rows(nothing[0]) == rows(nothing[1]) == []
