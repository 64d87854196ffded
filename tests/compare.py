"""Runs a Spark query and its oracle SQL on the same tables and compares the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def difference(spark, query, sql: str, sf_dir: str, con) -> str | None:
    """None if the results agree, else what differs."""
    df = query(spark, sf_dir)
    got_columns, got_rows = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_columns, want_rows = [d[0] for d in cursor.description], cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    got, want = bag(got_columns, got_rows), bag(want_columns, want_rows)
    if got == want:
        return None if got_rows else "no rows on both sides"
    extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"rows {len(got_rows)} / {len(want_rows)}\n only spark: {extra}\n only sql: {missing}"
