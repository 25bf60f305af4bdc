"""Sampling, ordering and training telemetry.

Top-k style operators (H1, H2) are ``orderBy(...).limit(n)``, which plans as
TakeOrderedAndProject (per-partition top-n, then a merge of n × partitions
rows): the limit is the feature there. Everything else is a filter or a
grouped aggregate on bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.rowindex import OrderedTable


def _seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, seed: int, key: str = "row_id", check: bool = True) -> DataFrame:
    """H1: exactly n rows without replacement (n must not exceed the row count)."""
    out = df.orderBy(_seeded_hash(key, seed), F.col(key)).limit(n)
    if check and df.limit(n).count() < n:
        raise ValueError(f"cannot sample {n} rows from fewer")
    return out


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """H2: the first n rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def row_at(table: OrderedTable, i: int) -> DataFrame:
    """H3: the row at 0-based position i of a table stored in order: one file is read, nothing is sorted."""
    return table.at(i)


def sample_batches(df: DataFrame, every: int, n: int, batch: str = "batch_id", pos: str = "row_idx") -> DataFrame:
    """H4: the first n rows of batches N, 2N, … (1-based count of processed
    batches). The window partition is one batch (bounded)."""
    picked = df.filter((F.col(batch) + 1) % every == 0)
    w = Window.partitionBy(batch).orderBy(pos)
    return picked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def bucket_mean(df: DataFrame, every: int, step: str = "step", value: str = "loss", by: Sequence[str] = ("run",),
                include_tail: bool = False) -> DataFrame:
    """H5: running mean flushed when ``step % N == 0 and step != 0``: the first
    bucket holds steps 0..N (N+1 values), later ones N values; the unflushed
    tail is not emitted unless ``include_tail``."""
    bucket = F.greatest(F.ceil(F.col(step) / every), F.lit(1)).cast("bigint")
    g = df.groupBy(*by, bucket.alias("bucket")).agg(F.avg(value).alias("loss_reduced"),
                                                    F.max(step).alias("_last"))
    if not include_tail:
        g = g.filter(F.col("_last") == F.col("bucket") * every)
    return g.select(*by, (F.col("bucket") * every).alias("step"), "loss_reduced")


def best_checkpoint(df: DataFrame, every: int, step: str = "step", value: str = "loss",
                    by: Sequence[str] = ("run",)) -> DataFrame:
    """H6: the checkpoint (taken every k steps) with the lowest loss; ties go to
    the earliest step."""
    pts = df.filter(F.col(step) % every == 0)
    best = F.min_by(F.struct(F.col(step).alias("step"), F.col(value).alias("loss")),
                    F.struct(F.col(value), F.col(step)))
    return pts.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.step", "_b.loss")


def validation_points(df: DataFrame, every: int, limit: int | None = None, step: str = "step") -> DataFrame:
    """H7: rows at every k steps; with ``limit`` only the first m such points."""
    out = df.filter(F.col(step) % every == 0).withColumn("point", (F.col(step) / every).cast("bigint"))
    return out if limit is None else out.filter(F.col("point") < limit)


def epoch_mean(df: DataFrame, value: str = "loss", weight: str = "n", epoch: str = "epoch",
               by: Sequence[str] = ()) -> DataFrame:
    """Per-epoch mean of a step metric weighted by batch size."""
    return df.groupBy(*by, epoch).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(f"{value}_epoch"))
