"""Compares a query with its DuckDB equivalent over one folder of tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if path.is_file() else f'{path}/*.parquet'}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, int | str | bool) or x is None:
        return x
    if hasattr(x, "as_integer_ratio"):
        return float(x)
    return str(x)


def differences(df, sql: str, folder: str) -> str:
    """Empty if columns and rows agree."""
    rel = connect(folder).execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(n)]) for n in order) for r in rel.fetchall())
    got = Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    if got == want:
        return ""
    return f"{order}: {sum(got.values())} and {sum(want.values())} rows; only in Spark: {list((got - want).items())[:3]}; only in SQL: {list((want - got).items())[:3]}"
