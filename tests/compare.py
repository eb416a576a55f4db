"""Rows of a query against its SQL, as the same multiset of normalised rows."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("SILTSTONE_TEST_DATA", "/root/testdata/sf0.001")


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(cols).collect()), key=str)


def rows_of_sql(con, sql):
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted(got.columns), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=str)
