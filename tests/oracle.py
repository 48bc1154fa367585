"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if value is not None and type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in records)


def assert_same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    found = rows(df.columns, df.collect())
    cursor = con.execute(sql)
    wanted = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert found[0] == wanted[0]
    assert found[1] == wanted[1], (list((found[1] - wanted[1]).items())[:3], list((wanted[1] - found[1]).items())[:3])
