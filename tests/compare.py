"""Compares a Spark result with DuckDB's, whatever the order of rows and columns."""

import math
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(df):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
