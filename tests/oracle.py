"""Compares a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return str(v)


def rows_of(records: list[dict]) -> Counter:
    return Counter(tuple((k, _plain(r[k])) for k in sorted(r)) for r in records)


def difference(df, sql: str, con) -> str:
    """Empty if both give the same columns and the same bag of rows."""
    ours = rows_of(df.toArrow().to_pylist())
    theirs = rows_of(con.execute(sql).to_arrow_table().to_pylist() if hasattr(con, "to_arrow_table") else con.sql(sql).to_arrow_table().to_pylist())
    if ours == theirs:
        return ""
    a, b = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{sum(ours.values())} rows, SQL {sum(theirs.values())}\nonly Spark: {a}\nonly SQL: {b}"
