"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.astype(object).itertuples(index=False):
        out.append(tuple("null" if x is None or (isinstance(x, float) and x != x) else f"{round(x, 6) + 0.0:.6f}" if isinstance(x, float) else str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x) for x in r))
    return sorted(out)
