"""Run a query on Spark and its SQL on DuckDB, and compare the sorted rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "None" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return str(value.date()) if value.time() == dt.time() else str(value)
    return str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows), [names[i] for i in order]


def spark_rows(df):
    return table([tuple(r) for r in df.collect()], df.columns)


def duck_rows(con, sql):
    result = con.execute(sql)
    return table(result.fetchall(), [c[0] for c in result.description])
