"""Comparison of a query with its SQL in DuckDB, insensitive to order."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return f"{round(float(v), 6) + 0.0:.6f}"
        return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def agree(spark, query, sql, sf_dir):
    ours, theirs = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    return len(ours)
