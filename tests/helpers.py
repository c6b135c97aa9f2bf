"""Comparing rows of Spark with rows of DuckDB."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v


def spark_rows(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=str)


def duck_rows(sql: str, data: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(found.columns), sorted((tuple(normal(r[i]) for i in order) for r in found.fetchall()), key=str)
