"""Loads that end at any point count once; tables are compacted while they are read."""

from threading import Lock

import pytest

from ingestctl import fixtures as fx
from ingestctl.operators import audit, control, publish
from ingestctl.plans import ingestion
from tests.conftest import rows
from tests.test_ingestion import entity, put, run


class Ended(BaseException):
    """The driver ends: nothing catches this."""


def end_at(monkeypatch, module, name, after=0, before=True):
    """The function ends the driver on its call number ``after`` (from 0), before or after its work."""
    real, calls, lock = getattr(module, name), [], Lock()

    def ending(*args, **options):
        with lock:
            calls.append(name)
            ends = len(calls) == after + 1
        if ends and before:
            raise Ended
        result = real(*args, **options)
        if ends:
            raise Ended
        return result

    monkeypatch.setattr(module, name, ending)


POINTS = [
    ("append", publish, "stage", 0, False),
    ("append", publish, "decide", 0, False),
    ("append", publish.Folder, "move_in", 1, True),
    ("append", ingestion, "record_once", 0, True),
    ("append", ingestion, "record_once", 1, False),
    ("overwrite", publish, "decide", 0, True),
    ("overwrite", publish, "decide", 0, False),
    ("overwrite", publish.Folder, "move_in", 1, False),
    ("overwrite", publish, "finish", 1, True),
]


@pytest.mark.parametrize("mode, module, name, after, before", POINTS)
def test_rows_once_wherever_a_load_ends(spark, database, tmp_path, mode, module, name, after, before):
    """Two steps of two files, over a table that a former load has filled."""
    put(tmp_path, "old.txt", "h\n0|x\n", 1_600_000_000)
    partitioned = '[{"column_name":"p","transformation_logic":"a % 3"}]'
    config = entity(database, tmp_path, Table_Mode=mode, Transformations=partitioned, Partition_Column="p")
    assert run(spark, config)["e"]["status"] == "SUCCESS"
    for i in range(1, 5):
        put(tmp_path, f"f{i}.txt", f"h\n{i}|x\n{i}0|y\n", 1_700_000_000 + i)
    with pytest.MonkeyPatch.context() as patch:
        end_at(patch, module, name, after, before)
        with pytest.raises(Ended):
            run(spark, config, max_files_per_step=2)
    assert run(spark, config, max_files_per_step=2)["e"]["status"] in ("SUCCESS", "NO_FILES")
    loaded = sorted(row["a"] for row in spark.table(f"{database}.e").collect())
    expected = [str(n) for i in range(1, 5) for n in (i, 10 * i)] + (["0"] if mode == "append" else [])
    assert loaded == sorted(expected)
    ledger = spark.table(f"{database}.ingestion_audit_files")
    names = [r["file_name"] for r in ledger.where("file_name IS NOT NULL").collect()]
    assert sorted(names) == ["f1.txt", "f2.txt", "f3.txt", "f4.txt", "old.txt"]
    assert not audit.load_is_unfinished(spark, f"{database}.ingestion_audit_files", f"{database}.e")
    assert run(spark, config)["e"]["status"] == "NO_FILES"
    assert publish.table_files(spark, f"{database}.e").folder.below(publish.STAGING).names() == []


def test_raw_copies_once(spark, database, tmp_path):
    put(tmp_path, "a.txt", "h\n1|x\n")
    config = entity(
        database, tmp_path, Raw_Ingestion_Flag="Y", Raw_Schema=f"{database}_raw",
        Transformations='[{"column_name":"PartitionColumn","transformation_logic":"\'d\'"}]',
    )
    spark.sql(f"CREATE DATABASE {database}_raw LOCATION '{tmp_path}_raw'")
    with pytest.MonkeyPatch.context() as patch:
        end_at(patch, ingestion, "record_once", 1)
        with pytest.raises(Ended):
            run(spark, config)
    run(spark, config)
    assert spark.table(f"{database}_raw.e").count() == spark.table(f"{database}.e").count() == 1
    spark.sql(f"DROP DATABASE {database}_raw CASCADE")


def test_a_completed_step_is_audited(spark, database, tmp_path):
    put(tmp_path, "a.txt", "h\n1|x\n2|y\n")
    with pytest.MonkeyPatch.context() as patch:
        end_at(patch, ingestion, "record_once")
        with pytest.raises(Ended):
            run(spark, entity(database, tmp_path))
    result = run(spark, entity(database, tmp_path))["e"]
    assert (result["status"], result["n_files"], result["file_row_count"]) == ("SUCCESS", 1, 2)
    row = spark.table(f"{database}.ingestion_audit").first()
    assert (row["file_names"], row["previous_row_count_in_table"], row["new_row_count_in_table"]) == (["a.txt"], 0, 2)


def test_bucketed_and_other_tables_are_written_directly(spark, database, tmp_path):
    spark.sql(f"CREATE TABLE {database}.e (a string, b string) USING json")
    assert publish.table_files(spark, f"{database}.e") is None
    put(tmp_path, "a.txt", "h\n1|x\n")
    assert run(spark, entity(database, tmp_path))["e"]["status"] == "SUCCESS"
    assert run(spark, entity(database, tmp_path))["e"]["status"] == "NO_FILES"
    assert rows(spark.table(f"{database}.e")) == [("1", "x")]
    with pytest.raises(ValueError, match="plain files"):
        publish.compact_table(spark, f"{database}.e")


def record_events(spark, table, n_runs=3):
    seq = 0
    for run_no in range(n_runs):
        for status in ("IN_PROGRESS", "IN_PROGRESS", "FAILED", "IN_PROGRESS", "COMPLETED"):
            seq += 1
            control.record_event(
                spark, table, batch_id=1 + run_no % 2, job_id="j", run_id=f"r{run_no}", status=status, seq=seq,
                error_message="oops" if status == "FAILED" else "",
            )


def test_events_are_compacted_in_place(spark, database):
    table = f"{database}.job_events"
    record_events(spark, table)
    before = rows(control.status_view(spark.table(table)))
    done = publish.compact_table(spark, table, control.compact_events)
    assert (done.files_before, done.files_after) == (15, 2)
    assert rows(control.status_view(spark.table(table))) == before
    control.record_event(spark, table, batch_id=1, job_id="j", run_id="r9", status="COMPLETED", seq=99)
    assert len(rows(control.status_view(spark.table(table)))) == 4
    again = publish.compact_table(spark, table, control.compact_events)
    assert (again.files_before, again.files_after, again.rows) == (3, 2, spark.table(table).count())


@pytest.mark.parametrize(
    "point", [(publish, "decide", 0, True), (publish, "decide", 0, False), (publish.Folder, "move_in", 1, True)]
)
def test_a_compaction_that_ends_early(spark, database, point):
    table = f"{database}.job_events"
    record_events(spark, table)
    before = rows(control.status_view(spark.table(table)))
    with pytest.MonkeyPatch.context() as patch:
        end_at(patch, *point)
        with pytest.raises(Ended):
            publish.compact_table(spark, table, control.compact_events)
    spark.catalog.refreshTable(table)
    assert rows(control.status_view(spark.table(table))) == before
    assert publish.compact_table(spark, table, control.compact_events).files_after == 2
    assert rows(control.status_view(spark.table(table))) == before


def test_audit_and_ledger_are_compacted(spark, database, tmp_path):
    config = entity(database, tmp_path)
    for i in range(3):
        put(tmp_path, f"f{i}.txt", f"h\n{i}|x\n", 1_700_000_000 + i)
        run(spark, config)
    for table in (f"{database}.ingestion_audit", f"{database}.ingestion_audit_files", f"{database}.e"):
        before = rows(spark.table(table))
        done = publish.compact_table(spark, table)
        assert done.files_before >= 3 and (done.files_after, done.rows) == (1, 3)
        assert rows(spark.table(table)) == before
    assert run(spark, config)["e"]["status"] == "NO_FILES"


def test_rows_appended_during_a_compaction_stay(spark, database):
    table = f"{database}.t"
    spark.range(5).write.saveAsTable(table)

    def keep(frame):
        spark.range(5, 7).write.mode("append").saveAsTable(table)
        return frame.where("id <> 2")

    publish.compact_table(spark, table, keep)
    assert rows(spark.table(table)) == [(0,), (1,), (3,), (4,), (5,), (6,)]


def test_an_empty_table(spark, database):
    spark.sql(f"CREATE TABLE {database}.t (a int) USING parquet")
    assert publish.compact_table(spark, f"{database}.t") == publish.Compacted(0, 0, 0)
