"""Runs a query and its oracle on one folder and compares rows."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x) if isinstance(x, decimal.Decimal) else x


def same(spark, con, f, sql, sf):
    df = f(spark, sf)
    columns = sorted(df.columns)
    expected = con.sql(sql)
    assert sorted(expected.columns) == columns
    got = sorted(repr(plain(tuple(r))) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    want = sorted(repr(plain(r)) for r in expected.select(",".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
    assert got
