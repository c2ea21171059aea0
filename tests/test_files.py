import gzip
import os

import pytest

from ingestctl.sources import files


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as handle:
        handle.write(text)
    return str(folder)


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("skip", [1, 3])
def test_skip_in_many_files_and_many_splits(spark, small_splits, tmp_path, skip):
    wanted = set()
    for number, n_rows in enumerate([0, 1, 2, 9_000, 5, 20_000, 700]):
        lines = [f"HEADER {i}" for i in range(skip)] + [f"{number}|{i}|padding" for i in range(n_rows)]
        write(tmp_path, f"f{number}.txt", "\n".join(lines) + "\n")
        wanted.update((str(number), str(i)) for i in range(n_rows))
    lines = files.read_lines(spark, str(tmp_path), skip)
    assert lines.rdd.getNumPartitions() > 7
    rows = files.parse_delimited(lines, "file,row,pad", "|").select("file", "row").collect()
    assert len(rows) == len(wanted)
    assert {tuple(row) for row in rows} == wanted


def test_skip_with_files_packed_by_default(spark, tmp_path):
    """Under default settings several small files share a task; skipping must still see each file."""
    for number in range(40):
        write(tmp_path, f"f{number}.txt", f"H1\nH2\n{number}\n")
    rows = files.read_lines(spark, str(tmp_path), 2).collect()
    assert sorted(int(row["value"]) for row in rows) == list(range(40))


def test_skip_in_compressed_files_and_other_line_ends(spark, tmp_path):
    with gzip.open(f"{tmp_path}/a.txt.gz", "wt") as handle:
        handle.write("H1\nH2\n1\n2\n")
    write(tmp_path, "b.txt", "H1\r\nH2\r\n3\r\n")
    rows = files.read_lines(spark, str(tmp_path), 2).collect()
    assert sorted(row["value"] for row in rows) == ["1", "2", "3"]


def test_skip_more_lines_than_there_are(spark, tmp_path):
    write(tmp_path, "a.txt", "only\ntwo\n")
    assert files.read_lines(spark, str(tmp_path), 5).count() == 0


def test_settings_of_the_session_reach_the_skipping_reader(spark, tmp_path):
    write(tmp_path, "a.txt", "h\n1\n")
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        reader = files._session_with_one_split_per_task(spark)
        assert reader.conf.get("spark.sql.files.ignoreMissingFiles") == "true"
        assert files.read_lines(spark, str(tmp_path), 1).sparkSession is spark
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")


@pytest.mark.parametrize("skip", [0, 1])
def test_delimited_quotes_short_long_and_blank_rows(spark, tmp_path, skip):
    text = "header\n" * skip + 'a|"b|c"|d\n\nshort\nw|x|y|z\n'
    write(tmp_path, "a.txt", text)
    rows = files.read_delimited(spark, str(tmp_path), "x, y,z", "|", skip).collect()
    assert [tuple(row) for row in rows] == [("a", "b|c", "d"), ("short", None, None), ("w", "x", "y")]


@pytest.mark.parametrize("configured, written", [("x01", "\u0001"), ("\x01", "\u0001"), ("Ç", "Ç")])
def test_special_delimiters(spark, tmp_path, configured, written):
    write(tmp_path, "a.txt", f"h\n1{written}é\n")
    rows = files.read_delimited(spark, str(tmp_path), "a,b", configured, 1).collect()
    assert [tuple(row) for row in rows] == [("1", "é")]


def test_data_line_width_respects_quotes(spark):
    assert files.data_line_width(spark, 'a|"b|c"|d', "|") == 3
    assert files.data_line_width(spark, "a\u0001b", "x01") == 2
    assert files.data_line_width(spark, "alone", "|") == 1


def test_fixed_width_is_not_trimmed(spark, tmp_path):
    write(tmp_path, "a.txt", "  1 ab \n 22 c\n")
    lines = files.read_lines(spark, str(tmp_path))
    rows = files.parse_fixed_width(lines, "n,t", "1-4,5-7").collect()
    assert [tuple(row) for row in rows] == [("  1 ", "ab "), (" 22 ", "c")]
    with pytest.raises(ValueError, match="1 column names for 2"):
        files.parse_fixed_width(lines, "n", "1-4,5-7")


def test_discovery_matches_whole_names_in_one_folder(spark, tmp_path):
    for name in ["a_1.dat", "a_2.dat", "b_1.dat", "a_1.dat.bak"]:
        write(tmp_path, name, "x")
    write(tmp_path / "deeper", "a_3.dat", "x")

    def found(pattern):
        listing = files.discover_files(spark, str(tmp_path), pattern)
        return sorted(row["file_name"] for row in listing.collect())

    assert found("a_*.dat") == ["a_1.dat", "a_2.dat"]
    assert found("?_1.dat") == ["a_1.dat", "b_1.dat"]
    assert found("[b-z]_*") == ["b_1.dat"]
    assert found("*.csv") == []


def test_discovery_reads_no_content(spark, tmp_path):
    write(tmp_path, "a.txt", "x")
    plan = files.discover_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_source_files(spark, tmp_path):
    write(tmp_path, "a.txt", "1\n2\n")
    write(tmp_path, "b.txt", "3\n")
    paths = [row["file_path"] for row in files.source_files(spark.read.text(str(tmp_path))).collect()]
    assert sorted(os.path.basename(path) for path in paths) == ["a.txt", "b.txt"]


@pytest.mark.parametrize("total_bytes", [None, 2_000])
@pytest.mark.parametrize("split", [64, 256, 1_000])
def test_skipped_lines_may_reach_over_several_splits(spark, tmp_path, total_bytes, split):
    long_line = "x" * 700  # longer than a split: some splits have no line
    write(tmp_path, "long.txt", "header line\n" * 120 + f"{long_line}\n" + "header line\n" * 79 + "1\n" * 50)
    write(tmp_path, "short.txt", "header line\n" * 150)
    write(tmp_path, "dense.txt", "\n" * 200 + "2\n" * 300)
    keys = ["spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"]
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, str(split))
        kept = files.read_lines(spark, str(tmp_path), 200, total_bytes=total_bytes)
        assert sorted(row["value"] for row in kept.collect()) == ["1"] * 50 + ["2"] * 300
        assert kept.columns == ["value", "file_path"]
        assert files.read_lines(spark, f"{tmp_path}/long.txt", 5, total_bytes=total_bytes).count() == 245
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert files.read_lines(spark, str(tmp_path), 200, total_bytes=total_bytes).count() == 350
