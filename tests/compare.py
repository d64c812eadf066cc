"""Compare a query with its SQL: columns sorted by name, rows in any order, floats to nine digits."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_tuple") and not isinstance(value, (list, tuple)):
        return f"{float(value):.9g}"
    if hasattr(value, "tzinfo"):
        return str(value.replace(tzinfo=None))
    return value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """Empty if equal; otherwise what differs."""
    ours = bag(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = bag(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    more, less = ours - theirs, theirs - ours
    if more or less:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(more.items())[:3]}, only SQL {list(less.items())[:3]}"
    return ""
