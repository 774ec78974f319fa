"""Compare a query with its SQL, as rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        source = str(f) if os.path.isfile(f) else f"{f}/*.parquet"
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def rows(columns: list[str], found) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in found)


def check(df, con, sql: str) -> int:
    ours = rows(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert ours == theirs
    return len(ours[1])
