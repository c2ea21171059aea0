import pytest

from ingestctl import spec


@pytest.mark.parametrize("value", ["Y", "yes", "TRUE", "1", 1, True, " t "])
def test_flag_set(value):
    assert spec.parse_flag(value) is True


@pytest.mark.parametrize("value", ["N", "no", "False", "0", 0, False, None, ""])
def test_flag_not_set(value):
    assert spec.parse_flag(value) is False


def test_flag_unknown():
    with pytest.raises(ValueError):
        spec.parse_flag("maybe")


def test_delimiter_aliases():
    assert spec.normalise_delimiter("x01") == "\u0001"
    assert spec.normalise_delimiter("\x01") == "\u0001"
    assert spec.normalise_delimiter("Ç") == "Ç"
    assert spec.normalise_delimiter("|") == "|"


def test_sizes():
    assert spec.parse_bytes("134217728b") == 134217728
    assert spec.parse_bytes("128m") == spec.parse_bytes("128MB") == 134217728
    assert spec.parse_bytes(" 1 GiB ") == 2**30
    assert spec.parse_bytes("42") == 42
    with pytest.raises(ValueError):
        spec.parse_bytes("many")


def test_positions():
    assert spec.parse_positions("1-5,6-11") == [(1, 5), (6, 11)]
    for bad in ["5-1", "0-3", "a-b", ""]:
        with pytest.raises(ValueError):
            spec.parse_positions(bad)


def test_transformations():
    assert spec.parse_transformations(None) == []
    assert spec.parse_transformations("  ") == []
    text = '[{"column_name": "a", "transformation_logic": "1"}]'
    assert spec.parse_transformations(text) == [("a", "1")]
    with pytest.raises(ValueError, match="not JSON"):
        spec.parse_transformations("[oops")


def test_partition_columns():
    assert spec.parse_partition_columns(None) == []
    assert spec.parse_partition_columns("") == []
    assert spec.parse_partition_columns("a") == ["a"]
    assert spec.parse_partition_columns(["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        spec.parse_partition_columns(3)


def test_qualified_names():
    assert spec.qualified("c", "s", "t") == "`c`.`s`.`t`"
    assert spec.qualified(None, "s", "t") == "`s`.`t`"
