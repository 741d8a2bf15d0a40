"""A query's rows against those of its SQL in DuckDB."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, (float, Decimal)) and math.isnan(v):
        return None
    if isinstance(v, (float, Decimal)):
        return float(f"{float(v):.9g}")
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


def counted(columns, rows):
    """Rows with columns in order of name, and how often each occurs."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], Counter(tuple(plain(r[i]) for i in at) for r in rows)


def by_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    return counted([c[0] for c in got.description], got.fetchall())


def by_spark(df):
    return counted(df.columns, df.collect())
