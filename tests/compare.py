"""Run a registered query in Spark and its SQL in DuckDB and compare the rows, order aside."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, connection, query, sql: str, sf_dir: str) -> str | None:
    """``None`` if both give the same columns and rows, else a short account."""
    df = query(spark, sf_dir)
    ours = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    cursor = connection.execute(sql)
    theirs = _sorted_rows([column[0] for column in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        only_ours = sorted(set(ours[1]) - set(theirs[1]))[:3]
        only_theirs = sorted(set(theirs[1]) - set(ours[1]))[:3]
        return f"{len(ours[1])} rows != {len(theirs[1])} rows; only ours {only_ours}; only SQL {only_theirs}"
    return None
