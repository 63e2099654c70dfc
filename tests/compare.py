"""A query of this repository against its SQL in DuckDB, order and column order aside."""

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns), ignore_index=True)


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    a, b = _sorted(a), _sorted(b)
    for c in a.columns:
        if pd.api.types.is_float_dtype(a[c]) or pd.api.types.is_float_dtype(b[c]):
            x, y = a[c].astype(float), b[c].astype(float)
            assert (((x - y).abs() <= 1e-6 * (1 + x.abs())) | (x.isna() & y.isna())).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
