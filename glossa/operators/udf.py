"""User-function surface.

* J1 ``batch_infer``: distributed inference with a pluggable model function via
  ``mapInPandas``. The model is built once per task (``model_factory``) and fed
  Arrow batches cut to ``batch_size`` rows; nothing is collected.
* K1 ``map_batches``: a user batch function over columns with a declared output
  schema (``mapInPandas``), optionally dropping the raw columns.
* K2 ``register_metric``: a named step metric = a SQL expression over columns
  plus a per-span aggregate. It is registered as a Spark SQL function
  (``CREATE TEMPORARY FUNCTION … RETURN expr``), which Catalyst inlines, so it
  stays native in both the DataFrame API and SQL. The aggregate is one of the
  built-in names, a function of a span's values (gathered per span:
  for spans of bounded size), or a ``UserAggregate``, which is computed in
  parts: each Arrow batch reduces its values to one state a span, and only
  states are shuffled and merged, so a span may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glossa.operators.attribution import _agg, span_position

GEN_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("generated_text", T.StringType()),
    T.StructField("references", T.ArrayType(T.StringType())),
])


def token_drop_model(k: int = 7, max_len: int | None = None) -> Callable[[list[str]], list[str]]:
    """Deterministic stand-in system (no model can be loaded here): the
    hypothesis of the templated input with every k-th token dropped; a
    generation budget ``max_len`` applies only when given."""
    marker = "\nhypothesis: "

    def generate(inputs: list[str]) -> list[str]:
        out = []
        for text in inputs:
            hyp = text.split(marker, 1)[1] if text and marker in text else ""
            toks = hyp.split()[:max_len]
            out.append(" ".join(t for i, t in enumerate(toks) if i % k != k - 1))
        return out
    return generate


def batch_infer(df: DataFrame, model_factory: Callable[[], Callable[[list[str]], list[str]]],
                batch_size: int = 32, key: str = "row_id", input_col: str = "input_text",
                refs_col: str = "references") -> DataFrame:
    """``(row_id, input_text, generated_text, references)`` in the export schema."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()  # once per task, not per batch or row
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                gen = model(chunk[input_col].tolist())
                yield pd.DataFrame({"row_id": chunk[key].to_numpy(), "input_text": chunk[input_col].to_numpy(),
                                    "generated_text": gen, "references": chunk[refs_col].to_numpy()})
    return df.select(key, input_col, refs_col).mapInPandas(run, GEN_SCHEMA)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType,
                drop: Sequence[str] = ()) -> DataFrame:
    """K1: apply ``fn`` to each Arrow batch; raw columns in ``drop`` are removed
    from what ``fn`` returns (``fn`` sees them)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf)
            yield out.drop(columns=[c for c in drop if c in out.columns])
    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class UserAggregate:
    """An aggregate in parts. A state is a list of doubles: ``zero()`` is that of no values, ``update(state, values)``
    takes an array of values in, ``merge(a, b)`` joins two states (in any order), and ``finish(state)`` is the result,
    a number or None."""

    zero: Callable[[], list[float]]
    update: Callable[[list[float], np.ndarray], list[float]]
    merge: Callable[[list[float], list[float]], list[float]]
    finish: Callable[[list[float]], float | None]


_HELD = 100_000  # spans whose states a task holds, to merge those of its batches before the shuffle


def user_aggregate(df: DataFrame, agg: UserAggregate, value: str, keys: Sequence[str], out: str) -> DataFrame:
    """``(keys…, out)``: ``agg`` over the non-null values of each key (nulls count as keys of their own; a key whose
    values are all null has the result of ``zero``)."""
    keys = list(keys)
    fields = {f.name: f for f in df.schema.fields}
    state = T.ArrayType(T.DoubleType())
    parts = T.StructType([*[T.StructField(k, fields[k].dataType) for k in keys], T.StructField("_state", state)])
    kinds = to_arrow_schema(parts)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[float]] = {}

        def table() -> pa.RecordBatch:
            cols = list(zip(*held)) if keys and held else [()] * len(keys)
            return pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(cols, kinds)],
                                               pa.array(list(held.values()), kinds.field("_state").type)], schema=kinds)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            found: dict[tuple, list[float]] = {}
            for key, x in zip(zip(*columns) if keys else repeat(()), batch.column(len(keys)).to_pylist()):
                values = found.setdefault(key, [])
                if x is not None and x == x:
                    values.append(x)
            for key, values in found.items():
                own = list(map(float, agg.update(agg.zero(), np.array(values, dtype=float))))
                held[key] = list(map(float, agg.merge(held[key], own))) if key in held else own
            if len(held) > _HELD:
                yield table()
                held.clear()
        yield table()

    @F.pandas_udf("double")
    def finished(spans: pd.Series) -> pd.Series:
        done = [agg.finish(list(map(float, reduce(agg.merge, [list(s) for s in states], agg.zero())))) for states in spans]
        return pd.Series(done, dtype="float64").astype(object).where(lambda x: x.notna(), None)

    once = df.select(*keys, F.col(value).cast("double").alias(value)).mapInArrow(partial, parts)
    # only lists of states are gathered: at most one a task and ``_HELD`` spans
    return once.groupBy(*keys).agg(F.collect_list("_state").alias("_states")).select(*keys, finished("_states").alias(out))


@dataclass(frozen=True)
class Metric:
    name: str
    params: tuple[tuple[str, str], ...]   # (argument, SQL type)
    body: str                             # SQL expression over the arguments
    aggregate: str | UserAggregate | Callable[[pd.Series], float]  # sum | mean | prod | absmax, or the user's own


METRICS: dict[str, Metric] = {}


def register_metric(spark: SparkSession, name: str, params: Sequence[tuple[str, str]], body: str,
                    aggregate: str | UserAggregate | Callable[[pd.Series], float] = "sum") -> Metric:
    """K2: register ``name(args) = body`` as a temporary SQL function and remember
    its span aggregate."""
    sig = ", ".join(f"{a} {t}" for a, t in params)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({sig}) RETURNS DOUBLE RETURN {body}")
    m = Metric(name, tuple(params), body, aggregate)
    METRICS[name] = m
    return m


def apply_metric(df: DataFrame, name: str, args: Sequence[str], keys: Sequence[str], step: str,
                 spans: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """Compute a registered metric per row, then aggregate it over the spans of
    ``step`` with the metric's aggregate (other steps keep their own value)."""
    m = METRICS[name]
    scored = df.select(*keys, step, F.expr(f"{name}({', '.join(args)})").alias(name))
    mapped = scored.withColumn(step, span_position(F.col(step), spans)) if spans else scored
    if isinstance(m.aggregate, UserAggregate):
        return user_aggregate(mapped, m.aggregate, name, [*keys, step], name)
    if callable(m.aggregate):
        fn = m.aggregate

        @F.pandas_udf("double")
        def whole(spans: pd.Series) -> pd.Series:
            return pd.Series([fn(pd.Series(values, dtype="float64")) for values in spans], dtype="float64")
        # one call a batch of spans; a null value reaches the function as NaN
        value = F.coalesce(F.col(name).cast("double"), F.lit(float("nan")))
        return mapped.groupBy(*keys, step).agg(F.collect_list(value).alias("_values")).select(
            *keys, step, whole("_values").alias(name))
    return mapped.groupBy(*keys, step).agg(_agg(m.aggregate, F.col(name)).alias(name))
