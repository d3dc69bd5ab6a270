"""Result tables of Spark and DuckDB as sorted plain values."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return "NULL"
    return repr(round(float(value), 6)) if isinstance(value, float) else str(value)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(plain)
    return df.sort_values(list(df.columns)).reset_index(drop=True)
