"""Runs a query's SQL in DuckDB and compares: names, row count, values without regard to order."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
        return int(x)
    return x


def rows(df):
    return sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))
