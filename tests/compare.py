"""Runs a query and its SQL side by side."""

import decimal
import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return int(v) if isinstance(v, bool) else v


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=key)
    con.execute(sql)
    names = [x[0] for x in con.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in con.fetchall()), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
