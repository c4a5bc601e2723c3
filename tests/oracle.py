"""Runs a registered query in Spark and its SQL in DuckDB, and compares rows by sorted column names."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def norm(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, f, sql: str, d: str) -> int:
    df = f(spark, d)
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    c = duck(d)
    got = c.execute(sql)
    right = rows([x[0] for x in got.description], got.fetchall())
    assert left[0] == right[0], (left[0], right[0])
    assert len(left[1]) == len(right[1]), (len(left[1]), len(right[1]))
    for a, b in zip(left[1], right[1]):
        assert a == b, (a, b)
    return len(left[1])
