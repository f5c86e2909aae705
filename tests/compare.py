"""Spark rows against DuckDB rows of the same tables."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else f"{v:.9g}"  # pandas holds nullable integers as floats
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (pd.Timestamp, datetime, date)):
        return str(pd.Timestamp(v).tz_localize(None))
    return str(v)


def rows(frame: pd.DataFrame) -> Counter:
    names = sorted(frame.columns)
    return Counter(zip(*([plain(v) for v in frame[n].astype(object)] for n in names), strict=True)) if len(frame) else Counter()
