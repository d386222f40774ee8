"""Row-for-row comparison of a Spark result with DuckDB SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from ..fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, counts and values agree."""
    mine = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = normal_rows([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return [f"columns {mine[0]} != {theirs[0]}"]
    if len(mine[1]) != len(theirs[1]):
        return [f"rows {len(mine[1])} != {len(theirs[1])}"]
    return [f"{a} != {b}" for a, b in zip(mine[1], theirs[1]) if a != b][:3]
