"""Hold a query's rows against those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if hasattr(x, "as_integer_ratio") and not isinstance(x, int):
        x = float(x)
        return x if math.isinf(x) or math.isnan(x) else float(f"{x:.8g}")
    return x


def rows(columns: list[str], found: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in found)


def differences(spark, query, sql: str, folder: str, con=None) -> list[str]:
    """What differs: names, or the first rows that only one side has."""
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = (con or connection(folder)).execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    a, b = rows(df.columns, got), rows(names, want)
    return [f"only ours {x}" for x in list((a - b).elements())[:3]] + [f"only SQL {x}" for x in list((b - a).elements())[:3]] + ([] if a == b else [f"{sum(a.values())} and {sum(b.values())} rows"])
