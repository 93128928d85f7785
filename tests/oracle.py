"""Runs a query and its DuckDB SQL over the same tables and compares them."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else v
    return v.item() if hasattr(v, "item") else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(con, df, sql):
    theirs = con.sql(sql)
    assert sorted(df.columns) == sorted(theirs.columns)
    mine, expected = rows(df.columns, df.collect()), rows(theirs.columns, theirs.fetchall())
    assert len(mine) == len(expected)
    for a, b in zip(mine, expected, strict=True):
        assert a == b
