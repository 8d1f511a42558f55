"""Compares a query with its SQL in DuckDB, rows in any order."""

import glob
import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "None" if isinstance(v, float) and math.isnan(v) else f"{float(v) + 0.0:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, relation.fetchall())
