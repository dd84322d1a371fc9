"""Compare a Spark result with DuckDB's over the same tables, as bags of rows."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> int:
    cur = duck(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = bag(names, cur.fetchall())
    got = bag(df.columns, df.collect())
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    extra, lost = got - want, want - got
    assert not extra and not lost, f"{sum(extra.values())} more {list(extra)[:3]}, {sum(lost.values())} missing {list(lost)[:3]}"
    return sum(got.values())
