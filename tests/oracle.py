"""Compares a query's rows with its SQL in DuckDB, order aside."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            db.execute(f"create view {table} as select * from '{path}'")
    return db


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (bool, int, float)) or hasattr(v, "item"):
            return f"{float(v):.9g}"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    a, b = normal(spark_frame), normal(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} rows / {len(b)} rows; first {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:2]}" if bad else ""
