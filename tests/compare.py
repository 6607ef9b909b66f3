"""Comparing a query's rows with those of its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()))
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
