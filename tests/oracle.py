"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import datetime

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return float(round(x, 6)) if x.__class__.__name__ == "Decimal" else x


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, db, query, sql, sf_dir) -> str:
    """Empty if equal; else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only ours {list((got - want).items())[:2]}; only SQL's {list((want - got).items())[:2]}"
    return ""
