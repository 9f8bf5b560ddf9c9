"""Comparing a query with its SQL the way the driver does: columns by name, rows without order."""
from __future__ import annotations

import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _cell(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, numbers.Real) and not isinstance(v, bool):
        return str(round(float(v), 6))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(df.columns)
    return sorted(tuple(map(_cell, r)) for r in df[names].itertuples(index=False, name=None))
