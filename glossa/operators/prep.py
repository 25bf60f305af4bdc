"""Projection / template / reshape operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Input templates of the three code paths.
TEMPLATES = {
    "canonical": ("premise: ", "\nhypothesis: "),
    "spaced_plural": ("premise: ", " \n hypotheses: "),
    "spaced": ("premise: ", " \n hypothesis: "),
}
TARGET_SEP = " \n "


def select_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B1."""
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """B2."""
    return df.drop(*cols)


def input_text(premise="premise", hypothesis="hypothesis", style: str = "canonical") -> Column:
    """B5 as an expression; ``concat`` (not ``concat_ws``) so a null input stays null."""
    a, b = TEMPLATES[style]
    p = F.col(premise) if isinstance(premise, str) else premise
    h = F.col(hypothesis) if isinstance(hypothesis, str) else hypothesis
    return F.concat(F.lit(a), p, F.lit(b), h)


def target_text(explanation: str, label: str = "label") -> Column:
    return F.concat(F.col(label).cast("string"), F.lit(TARGET_SEP), F.col(explanation))


def template_target(df: DataFrame, n: int = 1) -> DataFrame:
    """``target`` (n = 1) or ``target_1..3`` (n = 3)."""
    if n == 1:
        return df.withColumn("target", target_text("explanation_1"))
    for i in range(1, n + 1):
        df = df.withColumn(f"target_{i}", target_text(f"explanation_{i}"))
    return df


def refs_to_array(df: DataFrame, cols=("reference_texts_0", "reference_texts_1", "reference_texts_2"),
                  out: str = "references") -> DataFrame:
    """Three reference columns → one array column."""
    return df.withColumn(out, F.array(*[F.col(c) for c in cols])).drop(*cols)


def refs_to_columns(df: DataFrame, col: str = "references", prefix: str = "reference_texts_", n: int = 3) -> DataFrame:
    """Array → ``reference_texts_0..n-1`` (export schema)."""
    return df.select(*[c for c in df.columns if c != col],
                     *[F.col(col)[i].alias(f"{prefix}{i}") for i in range(n)])


def batch_arrays(df: DataFrame, batch_col: str, order_col: str, cols: Sequence[str]) -> DataFrame:
    """Batched (list-of-batches) form: one row per batch, one array per column,
    in batch order. A batch is bounded by the batch size."""
    st = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in cols])))
    g = df.groupBy(batch_col).agg(st.alias("_rows"))
    return g.select(batch_col, *[F.transform("_rows", _field(c)).alias(c) for c in cols])


def _field(name: str):
    return lambda r: r[name]


def unbatch(df: DataFrame, batch_col: str, cols: Sequence[str]) -> DataFrame:
    """List-of-batches → rows with the position inside the batch."""
    z = df.select(batch_col, F.posexplode(F.arrays_zip(*[F.col(c) for c in cols])).alias("pos_in_batch", "_z"))
    return z.select(batch_col, "pos_in_batch", *[F.col("_z")[c].alias(c) for c in cols])


def rename_metrics(df: DataFrame, prefix: str = "", mapping: dict[str, str] | None = None,
                   col: str = "metric") -> DataFrame:
    """Prefix metric keys and apply literal renames (e.g. ``val/`` → ``test/``)."""
    m = F.col(col)
    for src, dst in (mapping or {}).items():
        m = F.regexp_replace(m, "^" + src.replace("/", "\\/"), dst)
    return df.withColumn(col, F.concat(F.lit(prefix), m))
