import random
from collections import deque

import pytest

from ingestctl.operators import lineage
from tests.conftest import rows


def name(i):
    return f"dev.{['a_wt', 'b_tb', 'c'][i % 3]}.t{i}"


def walk(edges, root, expand=lambda parent, depth: True):
    """Breadth-first, one table at a time."""
    parents = {}
    for child, parent in edges:
        parents.setdefault(child, []).append(parent)
    depth, queue, upstream = {root: 0}, deque([root]), set()
    while queue:
        node = queue.popleft()
        for parent in parents.get(node, []):
            upstream.add(parent)
            if parent not in depth and expand(parent, depth[node]):
                depth[parent] = depth[node] + 1
                queue.append(parent)
    return depth, upstream


def random_edges(seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    return sorted((name(a), name(b)) for a, b in pairs if a != b)


def frame(spark, edges):
    return spark.createDataFrame([(c, p, None) for c, p in edges], "child string, parent string, table_type string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_and_depth_equal_a_walk(spark, seed):
    pairs = random_edges(seed)
    root = pairs[0][0]
    edges = frame(spark, pairs)
    expanded = lineage.expanded_tables(edges, root)
    depth, upstream = walk(pairs, root)
    assert {row["node"]: row["depth"] for row in expanded.collect()} == depth
    assert {row[0] for row in lineage.upstream_tables(edges, expanded).collect()} == upstream


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_suffix_rule_equals_a_walk(spark, seed):
    pairs = random_edges(seed)
    edges = frame(spark, pairs)
    for root in {pairs[0][0], pairs[-1][0]}:
        expanded = lineage.expanded_tables(edges, root, lineage.suffix_rule)
        _, upstream = walk(
            pairs, root, lambda parent, depth: "_wt" in parent or ("_tb" in parent and depth == 0)
        )
        assert {row[0] for row in lineage.upstream_tables(edges, expanded).collect()} == upstream


def test_root_is_upstream_of_itself_only_in_a_cycle(spark):
    cycle = frame(spark, [("a", "b"), ("b", "a")])
    assert rows(lineage.upstream_tables(cycle, lineage.expanded_tables(cycle, "a"))) == [("a",), ("b",)]
    line = frame(spark, [("a", "b"), ("b", "c")])
    assert rows(lineage.upstream_tables(line, lineage.expanded_tables(line, "a"))) == [("b",), ("c",)]
    assert rows(lineage.lineage_tables(line, lineage.expanded_tables(line, "b"))) == [("b",), ("c",)]


@pytest.mark.parametrize("levels", [1, 3])
def test_a_long_chain_with_short_cuts(spark, levels):
    pairs = [(name(i), name(i + 1)) for i in range(23)] + [(name(2), name(9)), (name(20), name(3)), (name(23), name(0))]
    expanded = lineage.expanded_tables(frame(spark, pairs), name(0), levels_per_job=levels)
    assert {row["node"]: row["depth"] for row in expanded.collect()} == walk(pairs, name(0))[0]


@pytest.mark.parametrize("levels", [1, 4])
def test_many_roots_equal_a_walk_from_each(spark, levels):
    pairs = random_edges(5)
    starts = [name(i) for i in range(0, 60, 4)] + ["unknown"]
    roots = spark.createDataFrame([(r, 1) for r in [*starts, starts[0], None]], "root string, node int")
    edges = frame(spark, [*pairs, pairs[0], (None, "a"), ("b", None)])
    expanded = lineage.expanded_tables_of_roots(edges, roots, levels)
    walks = {root: walk(pairs, root) for root in starts}
    assert rows(expanded) == sorted(((r, n, d) for r in starts for n, d in walks[r][0].items()), key=repr)
    upstream = lineage.upstream_tables_of_roots(edges, expanded)
    assert rows(upstream) == sorted(((r, t) for r in starts for t in walks[r][1]), key=repr)


def test_no_roots(spark):
    edges, roots = frame(spark, [("a", "b")]), spark.createDataFrame([], "root string")
    assert rows(lineage.expanded_tables_of_roots(edges, roots)) == []
    empty = lineage.expanded_tables_of_roots(frame(spark, []), spark.createDataFrame([("a",)], "root string"))
    assert rows(empty) == [("a", "a", 0)]


def test_a_table_that_all_roots_reach(spark):
    """Its pairs are half of all pairs, and have one key in the join with the edges."""
    pairs = [(f"r{i}", "hub") for i in range(3_000)] + [("hub", "x"), ("x", "y")]
    roots = spark.range(3_000).selectExpr("concat('r', id) AS root")
    expanded = lineage.expanded_tables_of_roots(frame(spark, pairs), roots)
    assert expanded.groupBy("depth").count().sort("depth").collect() == [(d, 3_000) for d in range(4)]


def test_edges_are_joined_where_they_lie(spark):
    with lineage.bucketed_edges(frame(spark, random_edges(1))) as edges:
        other = spark.createDataFrame([("a",)], "child string").hint("merge")
        plan = edges.join(other, "child")._jdf.queryExecution().sparkPlan().toString()
        executed = edges.join(other, "child")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in executed and "Bucketed: true" in executed
        assert executed.count("Exchange hashpartitioning(child") == 1
        assert "Exchange" not in plan
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_")]


def test_unknown_root(spark):
    edges = frame(spark, [("a", "b")])
    assert rows(lineage.lineage_tables(edges, lineage.expanded_tables(edges, "zz"))) == []


def test_node_details(spark):
    edges = spark.createDataFrame(
        [("x", "dev.s.t", "VIEW"), ("x", "odd", None)], "child string, parent string, table_type string"
    )
    details = lineage.node_details(edges, lineage.expanded_tables(edges, "x"))
    assert rows(details) == [("dev.s.t", "dev", "s", "t", "VIEW"), ("odd", "", "", "", None)]


def test_table_jobs(spark):
    tables = spark.createDataFrame([(t,) for t in "abcde"], "table_name string")
    history = spark.createDataFrame(
        [("a", 1, "r1"), ("a", 2, "r2"), ("b", 1, "r3"), ("c", 5, "gone"), ("d", 1, None), ("z", 1, "r1")],
        "table_name string, version long, run_id string",
    )
    params = "map<string,string>"
    runs = spark.createDataFrame(
        [
            ("r1", [], {"esp_job_id": "J0"}),
            ("r2", [(({"esp_job_id": "J1"},),)], {"esp_job_id": "no"}),
            ("r3", [(({"x": "y"},),), (({"esp_job_id": "second task"},),)], {"esp_job_id": "J3"}),
        ],
        f"run_id string, tasks array<struct<notebook_task: struct<base_parameters: {params}>>>, job_parameters {params}",
    )
    found = lineage.table_jobs(tables, history, runs)
    assert rows(found) == [("a", "J1"), ("b", "J3"), ("c", None), ("d", None), ("e", None)]
    assert rows(lineage.chain_edges(found)) == [
        ("a\nJ1", "b\nJ3"), ("b\nJ3", "c"), ("c", "d"), ("d", "e"),
    ]


def test_a_run_listed_twice_gives_its_table_once(spark):
    tables = spark.createDataFrame([("t",), ("u",)], "table_name string")
    history = spark.createDataFrame([("t", 1, "r0"), ("t", 2, "r1")], "table_name string, version int, run_id string")
    schema = "run_id string, tasks array<struct<notebook_task: struct<base_parameters: map<string,string>>>>, job_parameters map<string,string>"
    runs = spark.createDataFrame([("r1", [], {"esp_job_id": "j"})] * 2, schema)
    assert rows(lineage.table_jobs(tables, history, runs)) == [("t", "j"), ("u", None)]


def test_latest_runs_are_folded_in_a_hash_map(spark):
    history = spark.createDataFrame([("t", 1, "a"), ("t", 9, "b"), ("t", 9, "c"), ("u", None, "d")], "table_name string, version int, run_id string")
    assert rows(lineage.latest_runs(history)) == [("t", "c")]


def test_upstreams_of_roots_are_what_was_found(spark):
    """All pairs are read as they were found; only a way back to the root is joined with the edges."""
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", None), ("d", "c"), ("d", "c"), ("e", "e")]
    roots = spark.createDataFrame([("a",), ("d",), ("e",), ("z",)], "root string")
    edges = frame(spark, pairs)
    upstream = lineage.upstream_tables_of_roots(edges, lineage.expanded_tables_of_roots(edges, roots))
    assert upstream._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    above = {("a", t) for t in ("a", "b", "c", None)} | {("d", t) for t in ("a", "b", "c", None)} | {("e", "e")}
    assert rows(upstream) == sorted(above, key=repr)


def test_only_runs_that_count_are_grouped(spark):
    tables = spark.createDataFrame([("t",), ("u",)], "table_name string")
    history = spark.createDataFrame([("t", 2, "r1"), ("x", 3, "r2")], "table_name string, version int, run_id string")
    schema = "run_id string, tasks array<struct<notebook_task: struct<base_parameters: map<string,string>>>>, job_parameters map<string,string>"
    runs = spark.createDataFrame([(r, [], {"esp_job_id": "j"}) for r in ("r1", "r2", "r3")] * 2, schema)
    found = lineage.table_jobs(tables, history, runs)
    assert "LeftSemi, (run_id" in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == [("t", "j"), ("u", None)]
