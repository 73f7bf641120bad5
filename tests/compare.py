"""Side-by-side comparison of a registered query and its SQL."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) else round(value, 9))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    if ours == theirs:
        return None
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return f"rows {len(ours)} / {len(theirs)}; only ours {sorted(a - b)[:3]}; only theirs {sorted(b - a)[:3]}"
