"""Runs a query and its DuckDB SQL on the same tables and compares rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        files = f"{path}/**/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return int(v) if isinstance(v, bool) else v


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty when rows and columns agree."""
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, res.fetchall())
    if not mine and not theirs:
        return "no rows on either side, so nothing is compared"
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only Spark: {list((mine - theirs).items())[:3]}; only SQL: {list((theirs - mine).items())[:3]}"
