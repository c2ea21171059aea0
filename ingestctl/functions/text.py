"""Column functions over text: fixed-width slices, payloads, dependency lists, table names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payload texts use double quotes only; anything else is not JSON.
_STRICT = {"allowSingleQuotes": "false"}


def fixed_width_columns(
    source: str, names: list[str], ranges: list[tuple[int, int]]
) -> list[Column]:
    if len(names) != len(ranges):
        raise ValueError(f"{len(names)} column names for {len(ranges)} position ranges")
    return [
        F.substring(source, first, last - first + 1).alias(name)
        for name, (first, last) in zip(names, ranges)
    ]


def json_object(text: Column) -> Column:
    """JSON object text as a map of texts, NULL where it is not a JSON object.

    The whole text must be one object; the last entry of a repeated key counts.
    """
    return _parsed(text, "map<string,string>", _last_entries)


def _parsed(text: Column, kind: str, use: Callable[[Column], Column] = lambda value: value) -> Column:
    """``use`` of the one JSON value that the whole text is, NULL if it is none of that kind.

    The parser does not look at what follows a value. So the text is read as the one element of an
    array, and as the one value of an object: what ends the one too early breaks the other.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>", _STRICT)
    alone = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "struct<v:string>", _STRICT)["v"]
    return _bound(
        listed, lambda values: F.when((F.size(values) == 1) & alone.isNotNull(), _bound(F.get(values, F.lit(0)), use))
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_entries(entries: Column) -> Column:
    def without_earlier(pairs: Column) -> Column:
        later = F.transform(pairs, lambda pair, i: F.slice(pairs, i + 2, F.size(pairs))["key"])
        return F.map_from_entries(
            F.filter(pairs, lambda pair, i: ~F.array_contains(F.get(later, i), pair["key"]))
        )

    unique = _bound(F.map_keys(entries), lambda keys: F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(unique, entries).otherwise(_bound(F.map_entries(entries), without_earlier))


def json_map(text: Column) -> Column:
    """JSON object text as a map of texts, empty where it is not a JSON object."""
    return F.coalesce(json_object(text), F.expr("cast(map() as map<string,string>)"))


def json_list(text: Column) -> Column:
    """JSON array text as a list of texts, empty where it is not a JSON array."""
    return F.coalesce(_parsed(text, "array<string>"), F.expr("cast(array() as array<string>)"))


def listed_names(text: Column) -> Column:
    """Bracketed list text that is not JSON: outer brackets and all quotes dropped, split on commas."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", ""), "['\"]", "")
    return F.filter(F.transform(F.split(bare, ","), lambda name: F.trim(name)), lambda name: name != "")


def dependency_names(text: Column) -> Column:
    """Distinct task names in a ``depends_on`` text.

    JSON array first (its elements are names or objects with a ``task_key``), then bracketed
    list text; NULL and blank give an empty list.
    """
    from_array = F.transform(
        _parsed(text, "array<string>"),
        lambda entry: F.when(
            entry.startswith("{"), F.coalesce(F.get_json_object(entry, "$.task_key"), F.lit(""))
        ).otherwise(entry),
    )
    names = F.coalesce(from_array, listed_names(text), F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.filter(names, lambda name: name.isNotNull() & (name != "")))


def library_kind(library: Column, by: str = "prefix") -> Column:
    """``prefix``: dbfs: is a jar, else pypi. ``suffix``: .whl is a wheel, else a jar."""
    if by == "prefix":
        return F.when(library.startswith("dbfs:"), "jar").otherwise("pypi")
    if by == "suffix":
        return F.when(library.endswith(".whl"), "whl").otherwise("jar")
    raise ValueError(f"unknown rule {by!r}")


def table_name_part(table: Column, position: int) -> Column:
    """Part 0, 1 or 2 of ``catalog.schema.table``; empty where there are fewer than three parts."""
    parts = F.split(table, r"\.")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(position))).otherwise("")


def labelled(table: Column, job: Column) -> Column:
    """Table name, with the job on a second line where one is known (NULL and '' are not)."""
    return F.when(F.coalesce(job, F.lit("")) != "", F.concat_ws("\n", table, job)).otherwise(table)
