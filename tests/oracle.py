"""Runs a query on Spark and its oracle on DuckDB, and compares the rows without regard to order."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        name = p.name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or hasattr(value, "dtype") and value.dtype == bool:
        return bool(value)
    if isinstance(value, (int, str)):
        return value
    if hasattr(value, "item"):
        value = value.item()
    return round(float(value), 5) + 0.0 if isinstance(value, float) or type(value).__name__ == "Decimal" else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(df, con, sql):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows_of(names, con.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want
