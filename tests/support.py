"""Comparison of a query with its SQL on the same Parquet files."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TALLYFIELD_TESTDATA", "/root/testdata")


def _plain(v):
    """A value as the comparison sees it: doubles at nine digits, dates and times as text."""
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_plain(x) for x in v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat().removesuffix("T00:00:00")
    return v


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """All rows, columns by name and rows in one order."""
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, rows_of(pd.DataFrame(cur.fetchall(), columns=names, dtype=object))


def spark_rows(df) -> list[tuple]:
    return rows_of(pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object))


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if the query and the SQL give the same names and rows, else what differs."""
    names, want = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    have = spark_rows(df)
    if len(have) != len(want):
        return f"{len(have)} rows and {len(want)}"
    for a, b in zip(have, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(have, want))} of {len(want)} rows, the first {a} and {b}"
    return ""
