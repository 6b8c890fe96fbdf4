"""Runs a query and its SQL over one folder of the driver's tables and compares them as sets of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        path = f"{path}/*" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def differences(spark, con, query, sql: str, sf_dir: str) -> list:
    """A few rows that are in one result only; empty if the results are equal."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    if sorted(columns) != names:
        return [("columns", names, sorted(columns))]
    order = [columns.index(n) for n in names]
    want = Counter(tuple(plain(row[k]) for k in order) for row in out.fetchall())
    return [("ours", *x) for x in list((got - want).items())[:3]] + [("theirs", *x) for x in list((want - got).items())[:3]]
