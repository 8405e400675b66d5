"""Spark result against DuckDB result: columns by name, rows in any order, values by text."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sources videos transcripts_raw transcripts chunks eval_questions speakers reading_labels".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def canon(v):
    if isinstance(v, float):
        return "null" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in v.items()) + "}"
    return "null" if v is None else str(v)


def rows(columns, data) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(canon(r[i]) for i in order) for r in data)


def both(spark, con, query, sql, sf):
    """(columns and rows of Spark, columns and rows of DuckDB)."""
    df = query(spark, sf)
    got = [tuple(v.asDict(True) if hasattr(v, "asDict") else v for v in r) for r in df.collect()]
    cur = con.execute(sql)
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    return (sorted(df.columns), rows(df.columns, got)), (sorted(names), rows(names, want))
