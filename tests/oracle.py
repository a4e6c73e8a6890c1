"""Runs a registered query beside its SQL in DuckDB and compares the rows, whatever their order."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return str(x)


def counted(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, str]:
    """Rows of the query, and what differs ("" if nothing does)."""
    df = query(spark, sf_dir)
    mine = counted(df.columns, df.collect())
    res = con.sql(sql)
    theirs = counted(res.columns, res.fetchall())
    if sorted(df.columns) != sorted(res.columns):
        return sum(mine.values()), f"columns {sorted(df.columns)} and {sorted(res.columns)}"
    if mine == theirs:
        return sum(mine.values()), ""
    return sum(mine.values()), f"{sorted(df.columns)}: only here {list((mine - theirs).items())[:3]}, only there {list((theirs - mine).items())[:3]}"
