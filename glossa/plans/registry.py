"""Named queries: each is ``(spark, sf_dir) -> DataFrame`` plus an optional DuckDB twin.

The twin must return the same column names; doubles are rounded to 6 places on
both sides (``r6``) so that summation order cannot change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ops: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def r6(c, alias: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6)
    return out.alias(alias or (c if isinstance(c, str) else None)) if (alias or isinstance(c, str)) else out


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every top-level DOUBLE column to 6 places (result presentation)."""
    return df.select(*[F.round(F.col(f.name), 6).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])
