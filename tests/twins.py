"""Compares a query with its DuckDB twin, order-free, floats at nine digits, and without NaN, which engines do not agree on."""

from __future__ import annotations

import os
from collections import Counter

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        assert v == v, "NaN in a result: one engine's NaN is another's null"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (bool, int)):
        return float(v)
    try:
        return float(f"{float(v):.9g}") + 0.0
    except (TypeError, ValueError):
        return str(v)


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    there = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    here = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert here == there, (list((here - there).items())[:3], list((there - here).items())[:3])
