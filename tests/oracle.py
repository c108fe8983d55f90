"""Compares a query with its SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def rows_of(frame, cols):
    return sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


def connect(sf_dir: str):
    c = duckdb.connect(config={"threads": 2})
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def check(df, con, sql: str) -> None:
    got, want = df.toPandas(), con.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    nullable = [c for c in cols if isinstance(want[c].dtype, pd.Int64Dtype)]  # Spark's frame has such integers as floats
    got = got.astype({c: "Int64" for c in nullable})
    assert rows_of(got, cols) == rows_of(want, cols)
