import os

import pytest

from ingestctl import fixtures as fx
from ingestctl.plans.ingestion import ingest_all
from tests.conftest import rows


def put(folder, name, text, mtime=None):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)
    if mtime:
        os.utime(path, (mtime, mtime))
    return str(folder)


def run(spark, *config, **options):
    results = ingest_all(spark, fx.config_frame(spark, list(config)), "p1", "d1", "load", "w", "r", **options)
    return {row["entity_name"]: row for row in results.collect()}


def entity(database, folder, name="e", **changes):
    changes = {"Header": "a,b", "Skiplines": 1, **changes}
    return fx.config_row(database, name, str(folder), **changes)


def audit(spark, database):
    return spark.table(f"{database}.ingestion_audit").orderBy("processed_timestamp").collect()


def test_rerun_loads_nothing_twice_and_takes_new_deliveries(spark, database, tmp_path):
    put(tmp_path, "one.txt", "h\n1|x\n", 1_700_000_000)
    config = entity(database, tmp_path)
    assert run(spark, config)["e"]["status"] == "SUCCESS"
    assert run(spark, config)["e"]["status"] == "NO_FILES"
    put(tmp_path, "two.txt", "h\n2|y\n", 1_700_000_100)
    assert run(spark, config)["e"]["n_files"] == 1
    put(tmp_path, "one.txt", "h\n3|z\n", 1_700_000_200)
    assert run(spark, config)["e"]["file_row_count"] == 1
    assert rows(spark.table(f"{database}.e")) == [("1", "x"), ("2", "y"), ("3", "z")]
    log = audit(spark, database)
    assert [row["previous_row_count_in_table"] for row in log] == [0, 1, 2]
    assert [row["new_row_count_in_table"] for row in log] == [1, 2, 3]
    assert [row["file_names"] for row in log] == [["one.txt"], ["two.txt"], ["one.txt"]]


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_steps_of_bounded_size_load_every_file_once(spark, database, tmp_path, mode):
    for i in range(7):
        put(tmp_path, f"f{i}.txt", f"h\n{i}|x\n", 1_700_000_000 + i // 3)
    put(tmp_path, "header_only.txt", "h\n", 1_700_000_001)
    result = run(spark, entity(database, tmp_path, Table_Mode=mode), max_files_per_step=2)["e"]
    assert result["status"] == "SUCCESS" and result["file_row_count"] == 7
    assert sorted(row["a"] for row in spark.table(f"{database}.e").collect()) == [str(i) for i in range(7)]
    assert all(len(row["file_names"]) <= 2 for row in audit(spark, database))


def test_glob_characters_in_file_names(spark, database, tmp_path):
    for number, name in enumerate(["a[1].txt", "b{x}.txt", "a1.txt", "c d%20e.txt"]):
        put(tmp_path, name, f"h\n{number}|x\n")
    assert run(spark, entity(database, tmp_path))["e"]["n_files"] == 4
    assert sorted(row["a"] for row in spark.table(f"{database}.e").collect()) == ["0", "1", "2", "3"]


def test_entities_side_by_side(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "h\n1|x\n")
    names = [f"e{i}" for i in range(8)]
    results = run(spark, *[entity(database, folder, name) for name in names], concurrency=4)
    assert {row["status"] for row in results.values()} == {"SUCCESS"}
    assert sorted(row["entity_name"] for row in audit(spark, database)) == names
    assert spark.table(f"{database}.ingestion_audit_files").count() == 8


def test_overwrite_replaces_the_rows(spark, database, tmp_path):
    put(tmp_path, "one.txt", "h\n1|x\n2|x\n", 1_700_000_000)
    config = entity(database, tmp_path, Table_Mode="overwrite")
    run(spark, config)
    put(tmp_path, "two.txt", "h\n9|y\n", 1_700_000_100)
    run(spark, config)
    assert rows(spark.table(f"{database}.e")) == [("9", "y")]


def test_one_failure_does_not_stop_the_others(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "h\n1|x\n")
    results = run(
        spark,
        entity(database, folder, "bad_flag", Header_Flag="perhaps"),
        entity(database, folder, "bad_json", Transformations="{oops"),
        entity(database, folder, "bad_sql", Transformations='[{"column_name":"c","transformation_logic":"nope(a)"}]'),
        entity(database, folder, "bad_width", Header="a,b,c"),
        entity(database, folder, "fixed_mismatch", Delimiter="", Fixed_Length_Position="1-1,2-2,3-3"),
        entity(database, f"{folder}/missing", "no_folder"),
        entity(database, folder, "no_format", Delimiter=None),
        entity(database, folder, "no_raw_partition", Raw_Ingestion_Flag="Y"),
        entity(database, folder, "zz_good"),
    )
    assert results.pop("zz_good")["status"] == "SUCCESS"
    assert {row["status"] for row in results.values()} == {"FAILURE"}
    log = {row["entity_name"]: row for row in audit(spark, database)}
    assert all(log[name]["error_message"] and log[name]["file_row_count"] is None for name in results)
    assert log["no_folder"]["file_names"] == []
    assert log["bad_width"]["file_names"] == ["a.txt"]


def test_failed_files_are_taken_up_again(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "h\n1|x\n")
    assert run(spark, entity(database, folder, Header="a"))["e"]["status"] == "FAILURE"
    assert run(spark, entity(database, folder))["e"]["file_row_count"] == 1


def test_no_files_and_no_rows_leave_no_audit(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "only a header\n")
    results = run(
        spark, entity(database, folder, "no_files", File_Pattern="*.dat"), entity(database, folder, "no_rows")
    )
    assert results["no_files"]["status"] == "NO_FILES"
    assert results["no_rows"]["status"] == "EMPTY"
    assert not spark.catalog.tableExists(f"{database}.ingestion_audit")


def test_existing_table_gives_the_types_and_missing_columns(spark, database, tmp_path):
    spark.sql(f"CREATE TABLE {database}.e (a int, b string, c double) USING parquet")
    folder = put(tmp_path, "a.txt", "h\n1|x\nbad|y\n")
    assert run(spark, entity(database, folder))["e"]["status"] == "SUCCESS"
    assert rows(spark.table(f"{database}.e")) == [(1, "x", None), (None, "y", None)]
    put(folder, "b.txt", "h\n1|x|z\n")
    failed = run(spark, entity(database, folder, Header="a,b,surplus"))["e"]
    assert failed["status"] == "FAILURE" and "surplus" in failed["error_message"]


def test_without_header_columns_are_numbered(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "1|x|y\n")
    run(spark, entity(database, folder, Header_Flag="N", Skiplines=0))
    assert spark.table(f"{database}.e").columns == ["_c0", "_c1", "_c2"]


def test_null_delimiter_with_positions_is_fixed_width(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "h\n12ab\n")
    run(spark, entity(database, folder, Delimiter=None, Fixed_Length_Position="1-2,3-4"))
    assert rows(spark.table(f"{database}.e")) == [("12", "ab")]


@pytest.mark.parametrize("skip", [0, 1])
def test_ragged_rows_are_counted_and_loaded(spark, database, tmp_path, skip):
    text = "h\n" * skip + '1|x\n2\n3|y|z\n\n4|"a|b"\n5|\n'
    folder = put(tmp_path, "a.txt", text)
    result = run(spark, entity(database, folder, Skiplines=skip))["e"]
    assert (result["file_row_count"], result["ragged_row_count"]) == (5, 2)
    assert rows(spark.table(f"{database}.e")) == [("1", "x"), ("2", None), ("3", "y"), ("4", "a|b"), ("5", None)]


def test_ignore_mode_loads_only_a_new_table(spark, database, tmp_path):
    put(tmp_path, "a.txt", "h\n1|x\n", 1_700_000_000)
    put(tmp_path, "b.txt", "h\n2|x\n", 1_700_000_001)
    config = entity(database, tmp_path, Table_Mode="ignore")
    assert run(spark, config, max_files_per_step=1)["e"]["file_row_count"] == 2
    put(tmp_path, "c.txt", "h\n3|x\n", 1_700_000_002)
    assert run(spark, config)["e"]["file_row_count"] == 0
    assert spark.table(f"{database}.e").count() == 2


def test_duplicate_entities_are_refused(spark, database, tmp_path):
    with pytest.raises(ValueError, match="more than once"):
        run(spark, entity(database, tmp_path), entity(database, tmp_path))


def test_no_job_of_the_load_reads_a_file_twice_for_counting(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "h\n" + "".join(f"{i}|x\n" for i in range(1000)))
    result = run(spark, entity(database, folder, Partition_Column="b"))["e"]
    assert result["file_row_count"] == 1000
    assert spark.sql(f"SHOW PARTITIONS {database}.e").count() == 1


@pytest.mark.parametrize("mode", ["append", "overwrite", "ignore"])
def test_a_failed_step_is_taken_up_without_losing_the_others(spark, database, tmp_path, mode):
    put(tmp_path, "a.txt", "h\n1|x\n", 1_700_000_000)
    put(tmp_path, "b.txt", "h\n2|y|surplus\n", 1_700_000_001)
    put(tmp_path, "c.txt", "h\n3|z\n", 1_700_000_002)
    config = entity(database, tmp_path, Table_Mode=mode)
    assert run(spark, config, max_files_per_step=1)["e"]["status"] == "FAILURE"
    put(tmp_path, "b.txt", "h\n2|y\n", 1_700_000_001)
    assert run(spark, config, max_files_per_step=1)["e"]["file_row_count"] == 2
    assert rows(spark.table(f"{database}.e")) == [("1", "x"), ("2", "y"), ("3", "z")]
    put(tmp_path, "d.txt", "h\n4|w\n", 1_700_000_003)
    run(spark, config, max_files_per_step=1)
    expected = {"append": ["1", "2", "3", "4"], "overwrite": ["4"], "ignore": ["1", "2", "3"]}[mode]
    assert [row[0] for row in rows(spark.table(f"{database}.e"))] == expected


def test_a_load_that_ends_in_an_empty_step_is_finished(spark, database, tmp_path):
    put(tmp_path, "a.txt", "h\n1|x\n", 1_700_000_000)
    put(tmp_path, "b.txt", "h\n", 1_700_000_001)
    config = entity(database, tmp_path, Table_Mode="overwrite")
    run(spark, config, max_files_per_step=1)
    put(tmp_path, "c.txt", "h\n2|y\n", 1_700_000_002)
    run(spark, config)
    assert rows(spark.table(f"{database}.e")) == [("2", "y")]


RAW = (
    '[{"column_name":"PartitionColumn","transformation_logic":"concat(\'p\', 1)"},'
    '{"column_name":"doubled","transformation_logic":"cast(a as int) * 2"}]'
)


def test_raw_copy_holds_each_line_once(spark, database, tmp_path):
    put(tmp_path, "a.txt", "h\n1|x|surplus\n", 1_700_000_000)
    config = entity(database, tmp_path, Raw_Ingestion_Flag="Y", Raw_Schema=f"{database}_raw", Transformations=RAW)
    spark.sql(f"CREATE DATABASE {database}_raw LOCATION '{tmp_path}_raw'")
    for _ in range(2):
        assert run(spark, config)["e"]["status"] == "FAILURE"
    put(tmp_path, "a.txt", "h\n1|x\n", 1_700_000_000)
    for status in ("SUCCESS", "NO_FILES"):
        assert run(spark, config)["e"]["status"] == status
    put(tmp_path, "b.txt", "h\n2|y\n", 1_700_000_001)
    run(spark, config)
    assert rows(spark.table(f"{database}_raw.e")) == [("1|x", "p1"), ("2|y", "p1")]
    assert rows(spark.table(f"{database}.e").select("a", "doubled")) == [("1", 2), ("2", 4)]


def test_a_failed_raw_copy_is_taken_up_without_loading_twice(spark, database, tmp_path):
    put(tmp_path, "a.txt", "h\n1|x\n", 1_700_000_000)
    config = entity(database, tmp_path, Raw_Ingestion_Flag="Y", Raw_Schema=f"{database}_raw", Transformations=RAW)
    assert run(spark, config)["e"]["status"] == "FAILURE"  # the raw schema is not there
    spark.sql(f"CREATE DATABASE {database}_raw LOCATION '{tmp_path}_raw'")
    assert run(spark, config)["e"]["status"] == "SUCCESS"
    assert rows(spark.table(f"{database}_raw.e")) == [("1|x", "p1")]
    assert rows(spark.table(f"{database}.e").select("a")) == [("1",)]


def test_a_failing_audit_does_not_stop_the_others(spark, database, tmp_path):
    folder = put(tmp_path, "a.txt", "h\n1|x\n")
    results = run(
        spark, entity(database, folder, "bad_audit", Audit_Schema="no_such_schema"), entity(database, folder, "good")
    )
    assert results["good"]["status"] == "SUCCESS" and results["bad_audit"]["status"] == "FAILURE"
    assert results["bad_audit"]["error_message"]


def test_a_bad_value_in_a_derived_column_is_null(spark, database, tmp_path):
    put(tmp_path, "a.txt", "h\n1|x\nbad|y\n")
    text = '[{"column_name":"c","transformation_logic":"cast(a as int) + 1"}]'
    assert run(spark, entity(database, tmp_path, Transformations=text))["e"]["status"] == "SUCCESS"
    assert rows(spark.table(f"{database}.e").select("a", "c")) == [("1", 2), ("bad", None)]


@pytest.mark.parametrize("skip", [0, 1])
def test_lines_of_control_characters_are_blank(spark, database, tmp_path, skip):
    put(tmp_path, "a.txt", "h\n" * skip + "1\x01x\n\x01\n \t\n2\x01y\n")
    config = entity(database, tmp_path, Skiplines=skip, Delimiter="\x01")
    assert run(spark, config)["e"]["file_row_count"] == 2


def test_many_partition_values_make_few_files(spark, database, tmp_path):
    for i in range(20):
        put(tmp_path, f"f{i}.txt", "h\n" + "".join(f"{j}|v{j % 10}\n" for j in range(50)))
    run(spark, entity(database, tmp_path, Partition_Column="b"))
    files = spark.table(f"{database}.e").inputFiles()
    assert len(files) <= 20


def test_a_load_reads_the_ledger_of_its_own_tables_alone(spark, database, tmp_path):
    """And a file that comes late, older than all that were loaded, is loaded."""
    from ingestctl.operators import audit
    from ingestctl.sources.files import discover_files

    config = entity(database, tmp_path)
    put(tmp_path, "new.txt", "h\n1|x\n", 1_700_000_000)
    assert run(spark, config)["e"]["status"] == "SUCCESS"
    ledger = f"{database}.ingestion_audit_files"
    other = audit.ledger_rows(spark, "another.table", spark.table(ledger).collect(), "r")
    audit.append_ledger(other, ledger)
    own = f"`{database}`.`e`"
    assert {r["table_name"] for r in spark.table(ledger).collect()} == {own, "another.table"}
    listing = discover_files(spark, str(tmp_path), "*.txt")
    pending = audit.unprocessed_for(spark, listing, ledger, [own])
    assert pending.collect() == []
    physical = pending._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters: [" in line and "table_name" in line.split("PartitionFilters: [")[1].split("]")[0] for line in physical.splitlines())
    put(tmp_path, "late.txt", "h\n2|y\n", 1_600_000_000)
    assert run(spark, config)["e"]["n_files"] == 1
    assert sorted(r["a"] for r in spark.table(f"{database}.e").collect()) == ["1", "2"]


def test_a_ledger_without_partitions_goes_on(spark, database, tmp_path):
    from ingestctl.operators import audit

    spark.createDataFrame([], audit.LEDGER_SCHEMA).write.saveAsTable(f"{database}.ingestion_audit_files")
    put(tmp_path, "a.txt", "h\n1|x\n")
    config = entity(database, tmp_path)
    assert run(spark, config)["e"]["status"] == "SUCCESS" and run(spark, config)["e"]["status"] == "NO_FILES"
