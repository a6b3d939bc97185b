"""Spark result vs DuckDB oracle: same column names, same rows as a multiset."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        # pandas turns integer columns with NULLs into floats: compare 1.0 as 1.
        return int(v) if v.is_integer() else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object)
    rows = [tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[bool, str]:
    got_cols, got = rows_of(spark_df.toPandas())
    exp_cols, exp = rows_of(con.execute(sql).df())
    if got_cols != exp_cols:
        return False, f"columns differ: spark {got_cols} vs oracle {exp_cols}"
    if len(got) != len(exp):
        return False, f"row count differs: spark {len(got)} vs oracle {len(exp)}"
    if got != exp:
        bad = next(i for i, (a, b) in enumerate(zip(got, exp)) if a != b)
        return False, f"first differing row #{bad}: spark {got[bad]} vs oracle {exp[bad]}"
    return True, f"{len(got)} rows match"
