"""Local twin of the driver's correctness gate: Spark query vs DuckDB SQL."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

from glossa.sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark_df, con, sql: str):
    """Return (ok, message). Columns compared by sorted name, rows as a multiset."""
    s_cols = sorted(spark_df.columns)
    rel = con.sql(sql)
    d_cols = sorted(rel.columns)
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    s_rows = Counter(tuple(_norm(r[c]) for c in s_cols) for r in spark_df.select(*s_cols).collect())
    d_df = rel.fetchall()
    idx = [rel.columns.index(c) for c in s_cols]
    d_rows = Counter(tuple(_norm(r[i]) for i in idx) for r in d_df)
    if s_rows != d_rows:
        only_s = list((s_rows - d_rows).elements())[:3]
        only_d = list((d_rows - s_rows).elements())[:3]
        return False, (f"rows differ: spark={sum(s_rows.values())} duck={sum(d_rows.values())}\n"
                       f"  only spark: {only_s}\n  only duck: {only_d}")
    return True, f"{sum(s_rows.values())} rows match"
