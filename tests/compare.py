"""Spark's rows against DuckDB's, without regard to order."""

from __future__ import annotations

import datetime as dt
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def value(v: object) -> object:
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return v


def rows(names: list[str], found: list) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


def same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:  # noqa: ANN001
    """Empty if both have the same columns and rows, else the first difference."""
    own = con.execute(sql)
    names = [d[0] for d in own.description]
    want = rows(names, own.fetchall())
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {spark_df.columns} and {names}"
    if len(want) != len(got):
        return f"{len(got)} and {len(want)} rows"
    return next((f"{g} and {w}" for g, w in zip(got, want, strict=True) if g != w), "")
