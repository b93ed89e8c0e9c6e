"""Runs catalogue queries next to their oracle SQL and compares the results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _canonical(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "item"):
        return _canonical(value.item())
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, folder, function, sql):
    """None when both engines agree exactly, else a description of the difference."""
    df = function(spark, folder)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])} rows"
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(different)} of {len(ours[1])} rows differ, e.g. {different[0]}" if different else None
