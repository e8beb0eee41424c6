"""Run a query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def difference(spark_df, sql: str, connection) -> str | None:
    """None when columns and rows agree, else a short description."""
    result = connection.sql(sql)
    ours, theirs = sorted(spark_df.columns), sorted(result.columns)
    if ours != theirs:
        return f"columns {ours} != {theirs}"
    got = bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want = bag(result.columns, result.fetchall())
    if got == want:
        return None if got else "both empty"
    return (
        f"{sum(got.values())} rows against {sum(want.values())};"
        f" only Spark {list((got - want).items())[:2]};"
        f" only SQL {list((want - got).items())[:2]}"
    )
