"""Compares a query with its SQL in DuckDB, as bags of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql, sf_dir):
    """(rows only Spark has, rows only DuckDB has); the columns are the same."""
    df = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, exp = bag([tuple(r) for r in df.collect()], df.columns), bag(want.fetchall(), want.columns)
    return list((got - exp).items())[:3], list((exp - got).items())[:3]
