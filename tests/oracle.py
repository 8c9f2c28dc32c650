"""Comparison of a query with its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def database(sf_dir: str = DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v) + 0.0:.5f}".replace("-0.00000", "0.00000") if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None))


def same(spark, query, sql: str, sf_dir: str = DATA) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), database(sf_dir).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
