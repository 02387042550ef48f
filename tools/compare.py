"""Comparing a registered query's rows with those of its SQL."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

from loomcraft.catalog import QUERIES, SQL


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if isinstance(v, (datetime.datetime, datetime.date)) else v


def spark_rows(spark, sf_dir: str, name: str):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    return columns, Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def sql_rows(db, name: str):
    result = db.execute(SQL[name])
    have = [d[0] for d in result.description]
    columns = sorted(have)
    order = [have.index(c) for c in columns]
    return columns, Counter(repr(tuple(plain(r[i]) for i in order)) for r in result.fetchall())
