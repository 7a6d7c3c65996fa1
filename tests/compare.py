"""Run queries on both engines and compare names, row counts and values."""

from __future__ import annotations

import glob
import os

import duckdb

KINDS = {
    "byte": "int", "short": "int", "integer": "int", "long": "int", "double": "float",
    "float": "float", "string": "text", "boolean": "bool", "date": "date",
}


def duck(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, sf: str, query, sql: str) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g.\n    {sorted(df.columns)}\n    spark {bad[0][0]}\n    sql   {bad[0][1]}"
    return None
