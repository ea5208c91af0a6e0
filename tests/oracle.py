"""Runs a query and its SQL over the same Parquet tables and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

FOLDER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of_spark(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], list[str]]:
    got = con.execute(sql)
    have = [d[0] for d in got.description]
    names = sorted(have)
    at = [have.index(n) for n in names]
    return names, sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
