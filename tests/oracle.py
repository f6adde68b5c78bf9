"""Comparison of a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(x) for x in value)
    return value


def same(df, con, sql):
    relation = con.sql(sql)
    columns, rows = list(relation.columns), relation.fetchall()
    names = sorted(df.columns)
    assert names == sorted(columns)
    place = [columns.index(c) for c in names]
    left = sorted(repr(tuple(normal(v) for v in r)) for r in df.select(*names).collect())
    right = sorted(repr(tuple(normal(r[i]) for i in place)) for r in rows)
    assert left == right
