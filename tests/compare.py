"""Run queries in Spark and their SQL twins in DuckDB and compare the rows."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "as_integer_ratio") or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in records)


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, else a description of the difference; also the seconds Spark took."""
    start = time.time()
    frame = query(spark, sf_dir)
    spark_columns, spark_rows = rows(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - start
    if sql is None:
        return (None if spark_rows else f"{name}: no rows"), seconds
    result = con.execute(sql)
    duck_columns, duck_rows = rows([d[0] for d in result.description], result.fetchall())
    if spark_columns != duck_columns:
        return f"{name}: columns {spark_columns} != {duck_columns}", seconds
    if len(spark_rows) != len(duck_rows):
        return f"{name}: {len(spark_rows)} rows != {len(duck_rows)}", seconds
    if not spark_rows:
        return f"{name}: no rows", seconds
    wrong = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b]
    if wrong:
        a, b = wrong[0]
        where = [(c, x[:300], y[:300]) for c, x, y in zip(spark_columns, a, b) if x != y]
        return f"{name}: {len(wrong)} of {len(spark_rows)} rows differ, first {where} in {[x[:40] for x in a]}", seconds
    return None, seconds
