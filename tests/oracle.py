"""Runs a query and its SQL over one folder of tables and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"create view {p.stem} as from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def norm(v):
    if v is None or isinstance(v, bool):
        return repr(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(int(v)) if isinstance(v, int) else str(v)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def differences(spark_df, sql: str, con) -> str:
    """Empty if both give the same columns and rows."""
    want = con.sql(sql)
    a, b = rows_of(spark_df.columns, spark_df.collect()), rows_of(want.columns, want.fetchall())
    if a == b:
        return ""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    more, less = sorted(set(a[1]) - set(b[1])), sorted(set(b[1]) - set(a[1]))
    return f"{len(a[1])} and {len(b[1])} rows; only in Spark {more[:2]}; only in SQL {less[:2]}"
