"""DuckDB SQL over the same tables, one text per registered query.

The texts start from the original tables and compute what the control tables mean, not the
texts packed into them, so parsing and folding are checked against plain columns.
"""

from __future__ import annotations

_TABLE_NAME = "concat('dev.', CASE WHEN {0} % 2 = 0 THEN 'stg_wt' ELSE 'mart_tb' END, '.t', {0})"

_EVENTS = """
WITH d_events AS (
  SELECT event_id AS seq, ts, user_id % 10 AS batch_id, concat('p', event_id % 3) AS proj_id,
         'd0' AS dept_id, concat('job', user_id % 7) AS job_id,
         concat('parent', event_id % 4) AS parent_job_id,
         CASE WHEN event_type IN ('signup', 'view') THEN 'IN_PROGRESS'
              WHEN event_type IN ('purchase', 'click') THEN 'COMPLETED' ELSE 'FAILED' END AS status,
         CASE WHEN event_type = 'error' THEN concat('e', event_id) ELSE '' END AS err,
         concat('w', event_id % 5) AS workflow_id, cast(event_id % 40 AS varchar) AS run_id,
         concat('run/', event_id) AS run_url
  FROM events),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id, job_id, run_id ORDER BY seq) AS rn FROM d_events),
view AS (
  SELECT batch_id, job_id, run_id,
         arg_min(proj_id, seq) AS proj_id, arg_min(dept_id, seq) AS dept_id,
         arg_min(parent_job_id, seq) AS parent_job_id, arg_min(workflow_id, seq) AS workflow_id,
         arg_min(run_url, seq) AS run_url, arg_max(status, seq) AS status,
         coalesce(arg_max(ts, seq) FILTER (WHERE status = 'IN_PROGRESS'), arg_min(ts, seq)) AS start_time,
         arg_max(ts, seq) FILTER (WHERE status IN ('COMPLETED', 'FAILED') AND rn > 1) AS end_time,
         coalesce(arg_max(err, seq) FILTER (WHERE err <> ''), '') AS error_message
  FROM numbered GROUP BY batch_id, job_id, run_id),
d_jobs AS (
  SELECT DISTINCT user_id % 10 AS batch_id, concat('p', event_id % 3) AS proj_id, 'd0' AS dept_id,
         concat('job', event_id % 8) AS job_id FROM events)
"""

_CHILDREN = """
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS c, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f,
         max(o_orderkey) OVER (PARTITION BY o_custkey) AS l
  FROM orders),
defs AS (
  SELECT *, 0 AS again FROM base UNION ALL SELECT *, 1 AS again FROM base WHERE k % 17 = 0),
children AS (
  SELECT k, c, again, concat('J', c) AS esp_job_id, concat('t', k) AS task_name,
         k // 2 + again AS invocation_id,
         concat('job', c, '_', k, CASE again WHEN 1 THEN '_b' ELSE '' END) AS job_id,
         k % 2 = 0 AS runner,
         CASE WHEN k % 13 <> 0 THEN concat('scripts/t', k) END AS path,
         CASE WHEN again = 1 THEN [concat('t', l)]
              WHEN k % 6 = 0 THEN []
              WHEN k % 6 = 1 THEN [concat('t', f)]
              WHEN k % 6 = 2 THEN [concat('t', f), concat('t', l)]
              WHEN k % 6 = 3 THEN ['nope']
              WHEN k % 6 = 4 THEN [concat('t', l)]
              ELSE ['batch_check', concat('t', f)] END AS deps
  FROM defs WHERE c % 11 <> 0),
parents AS (
  SELECT c_custkey AS c, concat('J', c_custkey) AS esp_job_id, concat('p', c_custkey % 3) AS proj_id,
         concat('d', c_custkey % 2) AS dept_id, concat('job', c_custkey) AS job_id,
         CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS n_params,
         c_custkey % 7 <> 0 AS ok,
         c_custkey % 7 <> 0 AND c_custkey % 3 = 1 AS sets_catalog,
         c_custkey % 7 <> 0 AND c_custkey % 3 = 2 AS sets_schema
  FROM customer WHERE c_custkey % 11 <> 0),
named AS (
  SELECT DISTINCT esp_job_id, task_name, job_id, invocation_id, d.dep AS dep
  FROM children, unnest(deps) AS d(dep)),
valid AS (
  SELECT * FROM named n
  WHERE dep = 'batch_check'
     OR EXISTS (SELECT 1 FROM children t WHERE t.esp_job_id = n.esp_job_id AND t.task_name = n.dep)),
tasks AS (SELECT DISTINCT esp_job_id, task_name FROM children),
loose AS (
  SELECT * FROM tasks t
  WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.esp_job_id = t.esp_job_id AND v.dep = t.task_name)),
leaves AS (
  SELECT * FROM loose
  UNION ALL
  SELECT * FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM loose l WHERE l.esp_job_id = t.esp_job_id)),
last_defs AS (
  SELECT esp_job_id, task_name, arg_max(job_id, (invocation_id, job_id)) AS job_id
  FROM children GROUP BY ALL)
"""

_LINEAGE = f"""
WITH RECURSIVE numbered AS (
  SELECT DISTINCT a, b FROM (
    SELECT p_partkey AS a, 2 * p_partkey AS b FROM part
    UNION ALL SELECT p_partkey, 2 * p_partkey + 1 FROM part
    UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 11 = 0) e
  WHERE a <> b),
edges AS (
  SELECT {_TABLE_NAME.format('a')} AS child, {_TABLE_NAME.format('b')} AS parent,
         CASE b % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' END AS table_type
  FROM numbered),
root AS (
  SELECT {_TABLE_NAME.format('n')} AS node
  FROM (SELECT min(p_partkey) FILTER (WHERE p_partkey > 0) AS n FROM part) m),
reached AS (
  SELECT node FROM root
  UNION
  SELECT e.parent FROM reached r JOIN edges e ON e.child = r.node),
walked AS (
  SELECT child, parent, table_type FROM edges WHERE child IN (SELECT node FROM reached)),
lineage_tables AS (SELECT child AS table_name FROM walked UNION SELECT parent FROM walked),
history AS (
  SELECT {_TABLE_NAME.format('l_partkey')} AS table_name, l_orderkey * 10 + l_linenumber AS version,
         cast(l_orderkey AS varchar) AS run_id
  FROM lineitem),
latest AS (SELECT table_name, arg_max(run_id, version) AS run_id FROM history GROUP BY table_name),
run_jobs AS (
  SELECT cast(o_orderkey AS varchar) AS run_id,
         CASE o_orderkey % 3 WHEN 1 THEN concat('J', o_custkey) WHEN 2 THEN concat('K', o_custkey) END
           AS esp_job_id
  FROM orders),
table_jobs AS (
  SELECT t.table_name, r.esp_job_id
  FROM lineage_tables t LEFT JOIN latest l USING (table_name) LEFT JOIN run_jobs r USING (run_id)),
all_table_jobs AS (
  SELECT l.table_name, r.esp_job_id FROM latest l LEFT JOIN run_jobs r USING (run_id))
"""

_CHAIN = """
SELECT previous_label, label FROM (
  SELECT label, lag(label) OVER (ORDER BY table_name) AS previous_label
  FROM (SELECT table_name,
               CASE WHEN esp_job_id IS NULL THEN table_name
                    ELSE concat(table_name, chr(10), esp_job_id) END AS label
        FROM {0}) n) c
WHERE previous_label IS NOT NULL
"""

_ENTITY_CONFIG = """
WITH config AS (
  SELECT concat('p', p_partkey % 3) AS project_id, concat('d', p_partkey % 2) AS dept_id,
         concat('j', p_partkey % 5) AS job_id, concat(p_name, ' ', p_type) AS entity_name,
         concat('/landing/', p_brand, '/') AS src_path, concat('part', p_partkey, '_*.dat') AS file_pattern,
         CASE p_size % 3 WHEN 0 THEN '|' WHEN 1 THEN 'x01' ELSE '' END AS delimiter, p_size AS skiplines
  FROM part)
"""

_BY_NATION = """
SELECT n_name, count(*) AS n_rows FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE {0} GROUP BY n_name
"""

_AUDIT = """
SELECT '{0}' AS entity_name, 'SUCCESS' AS status, 0 AS previous_row_count_in_table,
       count(*) AS new_row_count_in_table, count(*) AS file_row_count, false AS has_error,
       true AS has_files, '*.txt' AS file_pattern, 'load' AS job_id, 'w1' AS workflow_id, 'r1' AS run_id
FROM {1}
"""

_TASK_GRAPH = """
    WITH RECURSIVE numbered AS (
      SELECT 'J' || (p_partkey % 7) AS j, p_partkey // 7 AS i FROM part WHERE p_partkey // 7 > 0),
    edges AS (
      SELECT DISTINCT j, 't' || i AS t, 't' || dep AS d
      FROM numbered, unnest([i // 2, i // 3, CASE WHEN i % 53 = 52 THEN 2 * i END]) AS u(dep) WHERE dep > 0),
    nodes AS (SELECT j, t FROM edges UNION SELECT j, d FROM edges),
    reach AS (
      SELECT j, t, d FROM edges
      UNION SELECT r.j, r.t, e.d FROM reach r JOIN edges e ON e.j = r.j AND e.t = r.d),
    cycles AS (SELECT DISTINCT j, t FROM reach WHERE t = d),
    stuck AS (SELECT j, t FROM cycles UNION SELECT r.j, r.t FROM reach r JOIN cycles c ON c.j = r.j AND c.t = r.d),
    paths AS (
      SELECT j, t, 0 AS len FROM nodes WHERE (j, t) NOT IN (SELECT (j, t) FROM edges)
      UNION
      SELECT e.j, e.t, p.len + 1 FROM paths p JOIN edges e ON e.j = p.j AND e.d = p.t
      WHERE (e.j, e.t) NOT IN (SELECT (j, t) FROM stuck))
"""

ORACLES: dict[str, str] = {
    "ingest_delimited_pipe": "SELECT * FROM customer",
    "ingest_resume_overwrite": "SELECT * FROM customer",
    "ingest_delimited_ctrl_a": "SELECT * FROM supplier",
    "ingest_delimited_cedilla": "SELECT * FROM part",
    "ingest_fixed_width": """
        SELECT lpad(cast(o_orderkey AS varchar), 15, ' ') AS order_text,
               rpad(o_orderpriority, 16, ' ') AS priority_text,
               lpad(cast(o_custkey AS varchar), 15, ' ') AS cust_text
        FROM orders""",
    "ingest_raw_lines": """
        SELECT concat_ws('|', event_id, user_id, event_type) AS raw_data, 'p0' AS partition_column
        FROM events""",
    "skip_header_over_splits": "SELECT o_orderkey, o_custkey FROM orders",
    "skip_leading_lines": """
        SELECT count(*) AS n_rows, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key,
               cast(sum(o_custkey) AS bigint) AS sum_custkey
        FROM orders""",
    "file_discovery": _BY_NATION.format("regexp_matches(n_name, '^N.TION_1')"),
    "source_file_list": "SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "unprocessed_files": _BY_NATION.format("NOT starts_with(n_name, 'NATION_1')"),
    "header_rename": "SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS brand FROM part",
    "column_count_check": """
        SELECT 1 + c_custkey % 5 AS width, count(*) AS n_rows, 1 + c_custkey % 5 = 3 AS matches
        FROM customer GROUP BY ALL""",
    "empty_input_gate": """
        SELECT 'no_files' AS entity_name, 'NO_FILES' AS status, 0 AS file_row_count, 0 AS n_audit_rows
        UNION ALL SELECT 'no_rows', 'EMPTY', 0, 0
        UNION ALL SELECT 'with_rows', 'SUCCESS', count(*), 1 FROM customer""",
    "ingest_after_a_crash": """
        SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 2 = 0""",
    "ingest_with_rules": """
        WITH counted AS (
          SELECT 'customer' AS entity_name, 'has key' AS rule_name, count(*) AS n_rows, 0 AS n_failed, 0.0 AS share
          FROM customer
          UNION ALL SELECT 'customer', 'balance', count(*), count(*) FILTER (WHERE NOT c_acctbal >= 0), 0.9 FROM customer
          UNION ALL SELECT 'orders', 'has key', count(*), 0, 0.0 FROM orders
          UNION ALL SELECT 'orders', 'finished', count(*), count(*) FILTER (WHERE o_orderstatus = 'O'), 0.01 FROM orders)
        SELECT entity_name, rule_name, n_rows, n_failed, n_failed <= share * n_rows AS passed,
               CASE WHEN bool_and(n_failed <= share * n_rows) OVER (PARTITION BY entity_name) THEN n_rows ELSE 0 END AS n_loaded
        FROM counted""",
    "ingest_derived_partitioned": """
        SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount,
               strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate,
               l_extendedprice * (1 - l_discount) AS net, strftime(l_shipdate, '%Y-%m') AS ship_month,
               cast(NULL AS varchar) AS load_note, l_returnflag
        FROM lineitem""",
    "derive_columns": """
        SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
               l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
               strftime(l_shipdate, '%Y-%m') AS ship_month
        FROM lineitem""",
    "derive_replace_column": "SELECT c_custkey, upper(c_name) AS c_name FROM customer",
    "impose_schema": """
        SELECT o_orderkey, cast(o_custkey AS integer) AS o_custkey, o_orderstatus,
               cast(cast(o_totalprice AS decimal(12, 2)) AS varchar) AS o_totalprice,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, cast(NULL AS varchar) AS o_clerk
        FROM orders""",
    "impose_schema_bad_values": """
        SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN cast(c_nationkey AS varchar) END AS c_nationkey,
               CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal
        FROM customer""",
    "all_null_rows": """
        SELECT count(*) FILTER (WHERE c_custkey % 7 = 0) AS n_all_null,
               count(*) FILTER (WHERE c_custkey % 7 <> 0) AS n_with_value
        FROM customer""",
    "config_select": _ENTITY_CONFIG + """
        SELECT entity_name, src_path, file_pattern, delimiter, skiplines FROM config
        WHERE project_id = 'p1' AND dept_id = 'd1' AND job_id = 'j3'""",
    "duplicate_entities": _ENTITY_CONFIG + """
        SELECT project_id, dept_id, job_id, entity_name, count(*) AS n_entries FROM config
        GROUP BY ALL HAVING count(*) > 1""",
    "write_append_counts": """
        SELECT s AS step, (s - 1) * n AS n_before, s * n AS n_after, n AS n_written, 2 * n AS n_in_table
        FROM (SELECT count(*) AS n FROM customer) c, (SELECT unnest([1, 2]) AS s) t""",
    "write_overwrite_counts": """
        SELECT s AS step, (s - 1) * n AS n_before, n AS n_after, n AS n_written, n AS n_in_table
        FROM (SELECT count(*) AS n FROM customer) c, (SELECT unnest([1, 2]) AS s) t""",
    "write_partitioned": """
        SELECT o_orderstatus, count(*) AS n_rows, cast(sum(o_custkey) AS bigint) AS sum_custkey
        FROM orders GROUP BY o_orderstatus""",
    "truncate_and_load": """
        SELECT table_name, 'SUCCESS' AS status, n AS n_rows, n AS n_in_table FROM (
          SELECT 'customer' AS table_name, count(*) AS n FROM customer
          UNION ALL SELECT 'supplier', count(*) FROM supplier
          UNION ALL SELECT 'part', count(*) FROM part
          UNION ALL SELECT 'orders', count(*) FROM orders) t""",
    "audit_success": _AUDIT.format("customer", "customer")
    + " UNION ALL "
    + _AUDIT.format("supplier", "supplier"),
    "audit_failure": _AUDIT.format("good_header", "customer")
    + """
        UNION ALL
        SELECT 'bad_header', 'FAILURE', -1, -1, -1, true, true, '*.txt', 'load', 'w1', 'r1'""",
    "open_batch": "SELECT max(o_orderkey) AS batch_id FROM orders WHERE o_orderstatus = 'O'",
    "job_status_fold": _EVENTS + """
        SELECT batch_id, job_id, run_id, proj_id, dept_id, parent_job_id, workflow_id, run_url, status,
               strftime(start_time, '%Y-%m-%d %H:%M:%S.%f') AS start_time,
               strftime(end_time, '%Y-%m-%d %H:%M:%S.%f') AS end_time, error_message
        FROM view""",
    "job_status_of_compacted_events": _EVENTS + """
        SELECT batch_id, job_id, run_id, proj_id, dept_id, parent_job_id, workflow_id, run_url, status,
               strftime(start_time, '%Y-%m-%d %H:%M:%S.%f') AS start_time,
               strftime(end_time, '%Y-%m-%d %H:%M:%S.%f') AS end_time, error_message
        FROM view""",
    "already_executed": _EVENTS + """
        SELECT * FROM d_jobs j WHERE EXISTS (
          SELECT 1 FROM view v WHERE v.batch_id = j.batch_id AND v.proj_id = j.proj_id
            AND v.dept_id = j.dept_id AND v.job_id = j.job_id AND v.status = 'COMPLETED')""",
    "runnable_jobs": _EVENTS + """
        SELECT * FROM d_jobs j WHERE NOT EXISTS (
          SELECT 1 FROM view v WHERE v.batch_id = j.batch_id AND v.proj_id = j.proj_id
            AND v.dept_id = j.dept_id AND v.job_id = j.job_id AND v.status = 'COMPLETED')""",
    "parent_job_lookup": """
        SELECT concat('p', o_custkey % 3) AS proj_id, concat('d', o_custkey % 2) AS dept_id,
               concat('job', o_custkey) AS job_id, o_orderkey,
               CASE WHEN c_custkey IS NOT NULL THEN concat('job', o_custkey) END AS parent_job_id
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 11 <> 0""",
    "run_task_events": """
        SELECT 'load_orders' AS job_id, 'COMPLETED' AS status, false AS has_error, true AS has_ended,
               count(*) AS n_rows FROM orders
        UNION ALL SELECT 'load_parts', 'COMPLETED', false, true, count(*) FROM part
        UNION ALL SELECT 'check_parts', 'FAILED', true, true, 0""",
    "sql_literal_task": """
        SELECT 'orders by status' AS message, o_orderstatus, count(*) AS n_orders
        FROM orders WHERE o_totalprice >= 1000 GROUP BY o_orderstatus""",
    "job_parent": _CHILDREN + """
        SELECT esp_job_id, proj_id, dept_id, job_id, n_params, CASE WHEN ok THEN 'dev' END AS env
        FROM parents""",
    "job_children": _CHILDREN + """
        SELECT esp_job_id, invocation_id, job_id, task_name,
               CASE WHEN runner THEN 'true' WHEN k % 3 <> 0 THEN 'false' END AS use_runner,
               path AS notebook_path, 'task' AS parameter_type
        FROM children""",
    "eav_children": """
        SELECT concat('p', o_custkey % 3) AS proj_id, concat('d', o_custkey % 2) AS dept_id,
               concat('job', o_custkey) AS job_id, concat('t', o_orderkey) AS name,
               cast(o_orderkey AS integer) AS sequence
        FROM orders""",
    "eav_attribute": """
        SELECT concat('p', o_custkey % 3) AS proj_id, concat('d', o_custkey % 2) AS dept_id,
               concat('job', o_custkey) AS job_id, concat('scripts/t', min(o_orderkey)) AS param_val
        FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY o_custkey""",
    "json_params": _CHILDREN + """
        SELECT esp_job_id, task_name, job_id, k % 10 <> 0 AS is_valid,
               CASE WHEN k % 10 <> 0 THEN 'dev' END AS catalog_name,
               CASE WHEN k % 10 <> 0 THEN concat('s', k % 5) END AS schema_name,
               CASE WHEN k % 7 > 1 THEN concat('c', k % 3) END AS cluster_key,
               CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_libraries
        FROM children""",
    "task_levels": _TASK_GRAPH + """
        SELECT j AS esp_job_id, t AS task_name, cast(max(len) AS integer) AS level FROM paths GROUP BY ALL""",
    "cyclic_tasks": _TASK_GRAPH + "SELECT j AS esp_job_id, t AS task_name FROM stuck",
    "depends_on_parse": _CHILDREN + """
        SELECT esp_job_id, task_name, dep AS depends_on FROM named""",
    "valid_dependencies": _CHILDREN + """
        SELECT DISTINCT esp_job_id, task_name, dep AS depends_on FROM valid""",
    "dropped_dependencies": _CHILDREN + """
        SELECT DISTINCT esp_job_id, task_name, dep AS depends_on FROM named WHERE dep = 'nope'""",
    "task_edges": _CHILDREN + """
        , kept AS (
          SELECT DISTINCT v.esp_job_id, v.task_name, v.dep FROM valid v JOIN last_defs USING (esp_job_id, task_name, job_id))
        SELECT esp_job_id, 'job_execution_check' AS task_name, 'batch_check' AS depends_on FROM parents
        UNION ALL SELECT esp_job_id, 'status_update_in_progress', 'job_execution_check' FROM parents
        UNION ALL SELECT esp_job_id, task_name, dep FROM kept
        UNION ALL SELECT esp_job_id, task_name, 'status_update_in_progress' FROM tasks t
                  WHERE NOT EXISTS (SELECT 1 FROM kept v
                                    WHERE v.esp_job_id = t.esp_job_id AND v.task_name = t.task_name)
        UNION ALL SELECT esp_job_id, 'status_update_completed', task_name FROM leaves""",
    "job_tasks": _CHILDREN + """
        SELECT esp_job_id, n.task_name, n.run_path, n.status FROM parents, (VALUES
          ('batch_check', 'control/batch', NULL), ('job_execution_check', 'control/executed', NULL),
          ('status_update_in_progress', 'control/mark', 'IN_PROGRESS'),
          ('status_update_completed', 'control/mark', 'COMPLETED')) AS n(task_name, run_path, status)
        UNION ALL
        SELECT DISTINCT esp_job_id, task_name, CASE WHEN runner THEN 'utility/runner_main' ELSE path END, NULL
        FROM children""",
    "leaf_tasks": _CHILDREN + "SELECT esp_job_id, task_name FROM leaves",
    "linear_chain_deps": _CHILDREN + """
        , chained AS (
          SELECT *, lag(task_name) OVER (PARTITION BY esp_job_id ORDER BY invocation_id, task_name, job_id) AS previous
          FROM children WHERE path IS NOT NULL)
        SELECT esp_job_id, task_name, d.dep AS depends_on
        FROM chained,
             unnest(CASE WHEN len(deps) > 0 THEN list_distinct(deps)
                         ELSE [coalesce(previous, 'status_update_in_progress')] END) AS d(dep)""",
    "linear_chain_closing": _CHILDREN + """
        , chained AS (
          SELECT esp_job_id, task_name,
                 row_number() OVER (PARTITION BY esp_job_id
                                    ORDER BY invocation_id DESC, task_name DESC, job_id DESC) AS rn
          FROM children WHERE path IS NOT NULL)
        SELECT p.esp_job_id, 'status_update_completed' AS task_name,
               coalesce(c.task_name, 'status_update_in_progress') AS depends_on
        FROM parents p LEFT JOIN (SELECT * FROM chained WHERE rn = 1) c USING (esp_job_id)""",
    "job_level_params": _CHILDREN + """
        SELECT esp_job_id, n.name, n.value, 'standard' AS origin FROM parents, (VALUES
          ('workflow_id', '{{job.id}}'), ('run_id', '{{job.run_id}}'), ('env', '${var.env}'),
          ('rerun_flag', 'N')) AS n(name, value)
        UNION ALL SELECT esp_job_id, 'esp_job_id', esp_job_id, 'standard' FROM parents
        UNION ALL SELECT esp_job_id, 'proj_id', proj_id, 'standard' FROM parents
        UNION ALL SELECT esp_job_id, 'dept_id', dept_id, 'standard' FROM parents
        UNION ALL SELECT esp_job_id, 'job_id', job_id, 'standard' FROM parents
        UNION ALL SELECT esp_job_id, 'parent_job_id', concat('job', c), 'standard' FROM parents
        UNION ALL SELECT esp_job_id, 'env', 'dev', 'payload' FROM parents WHERE ok
        UNION ALL SELECT esp_job_id, 'catalog_name', 'top', 'payload' FROM parents WHERE sets_catalog
        UNION ALL SELECT esp_job_id, 'schema_name', 'top', 'payload' FROM parents WHERE sets_schema""",
    "task_effective_params": _CHILDREN + """
        , payload AS (
          SELECT ch.*, p.sets_catalog, p.sets_schema FROM children ch JOIN parents p USING (esp_job_id))
        SELECT esp_job_id, task_name, 'catalog_name' AS name, 'dev' AS value FROM payload
          WHERE k % 10 <> 0 AND NOT sets_catalog
        UNION ALL SELECT esp_job_id, task_name, 'schema_name', concat('s', k % 5) FROM payload
          WHERE k % 10 <> 0 AND NOT sets_schema
        UNION ALL SELECT esp_job_id, task_name, 'child_job_id', job_id FROM payload
        UNION ALL SELECT esp_job_id, task_name, 'notebook_path', path FROM payload WHERE runner""",
    "task_runner_path": _CHILDREN + """
        SELECT esp_job_id, task_name, CASE WHEN runner THEN 'utility/runner_main' ELSE path END AS run_path,
               CASE WHEN runner THEN path END AS notebook_path_parameter
        FROM children""",
    "cluster_registry": _CHILDREN + """
        , keyed AS (
          SELECT *, concat('c', k % 3) AS cluster_key,
                 row_number() OVER (PARTITION BY esp_job_id, k % 3 ORDER BY invocation_id, task_name) AS rn
          FROM children WHERE k % 7 > 1)
        SELECT esp_job_id, cluster_key, task_name AS defined_by,
               concat('{"job_cluster_key":"', cluster_key, '","new_cluster":{"num_workers":', k % 4, '}}')
                 AS cluster_details
        FROM keyed WHERE rn = 1""",
    "task_clusters": _CHILDREN + """
        SELECT DISTINCT esp_job_id, task_name,
               CASE c % 4 WHEN 0 THEN concat('jc', c % 5)
                          WHEN 1 THEN concat(esp_job_id, '_default_cluster') END AS cluster_key
        FROM children""",
    "task_clusters_own": _CHILDREN + """
        SELECT esp_job_id, task_name, CASE WHEN k % 7 > 1 THEN concat('c', k % 3) END AS cluster_key
        FROM children""",
    "control_task_clusters": _CHILDREN + """
        SELECT esp_job_id, n.task_name,
               CASE c % 4 WHEN 0 THEN concat('jc', c % 5)
                          WHEN 1 THEN concat(esp_job_id, '_default_cluster') END AS cluster_key
        FROM parents, (VALUES ('batch_check'), ('job_execution_check'), ('status_update_in_progress'),
                              ('status_update_completed')) AS n(task_name)""",
    "job_cluster_list": _CHILDREN + """
        SELECT esp_job_id,
               CASE c % 4 WHEN 0 THEN concat('jc', c % 5) ELSE concat(esp_job_id, '_default_cluster') END
                 AS cluster_key
        FROM parents WHERE c % 4 IN (0, 1)""",
    "library_kinds": _CHILDREN + """
        SELECT esp_job_id, task_name, 'dbfs:/x.jar' AS library, 'jar' AS kind, 'jar' AS kind_by_suffix
        FROM children WHERE k % 3 = 0
        UNION ALL SELECT esp_job_id, task_name, 'numpy', 'pypi', 'jar' FROM children WHERE k % 3 = 0
        UNION ALL SELECT esp_job_id, task_name, 'pkg.whl', 'pypi', 'whl' FROM children WHERE k % 3 = 1""",
    "foreach_expand": """
        SELECT concat('J', o_custkey) AS esp_job_id, concat('t', o_orderkey) AS task_name,
               concat('t', o_orderkey, '_iteration_', u.v) AS iteration, u.v AS value
        FROM orders, unnest([concat('src', o_orderkey % 7), concat('src', 10 + o_orderkey % 5)]) AS u(v)""",
    "upstream_closure": _LINEAGE + "SELECT DISTINCT parent AS table_name FROM walked",
    "upstream_depth": _LINEAGE + """
        , levels(table_name, depth) USING KEY (table_name) AS (
          SELECT node, 0 FROM root
          UNION
          SELECT e.parent, l.depth + 1 FROM levels l JOIN edges e ON e.child = l.table_name
          WHERE e.parent NOT IN (SELECT table_name FROM recurring.levels))
        SELECT table_name, cast(depth AS bigint) AS depth FROM levels""",
    "upstream_closure_of_roots": _LINEAGE + """
        , reach AS (
          SELECT concat('dev.', CASE WHEN n % 2 = 0 THEN 'stg_wt' ELSE 'mart_tb' END, '.t', n) AS root, root AS node
          FROM (SELECT n_nationkey + 1 AS n FROM nation)
          UNION
          SELECT r.root, e.parent FROM reach r JOIN edges e ON e.child = r.node)
        SELECT DISTINCT r.root, e.parent AS table_name FROM reach r JOIN edges e ON e.child = r.node""",
    "upstream_suffix_rule": _LINEAGE + """
        , expanded AS (
          SELECT node FROM root
          UNION
          SELECT e.parent FROM expanded x JOIN edges e ON e.child = x.node
          WHERE contains(split_part(e.parent, '.', 2), '_wt')
             OR (contains(split_part(e.parent, '.', 2), '_tb') AND x.node = (SELECT node FROM root)))
        SELECT DISTINCT parent AS table_name FROM edges WHERE child IN (SELECT node FROM expanded)""",
    "lineage_adjacency": _LINEAGE + "SELECT child, parent FROM walked",
    "lineage_tables": _LINEAGE + "SELECT table_name FROM lineage_tables",
    "lineage_node_details": _LINEAGE + """
        SELECT parent AS table_name, split_part(parent, '.', 1) AS catalog_name,
               split_part(parent, '.', 2) AS schema_name, split_part(parent, '.', 3) AS name,
               max(table_type) AS table_type
        FROM walked GROUP BY parent""",
    "latest_run_per_table": _LINEAGE + "SELECT table_name, run_id FROM latest",
    "table_job_lineage": _LINEAGE + "SELECT table_name, esp_job_id FROM table_jobs",
    "lineage_chain_edges": _LINEAGE + _CHAIN.format("table_jobs"),
    "all_table_chain_edges": _LINEAGE + _CHAIN.format("all_table_jobs"),
}
