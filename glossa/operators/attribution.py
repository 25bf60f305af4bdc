"""Attribution tables (J5–J9) in long form ``(seq_id, src_pos, tgt_pos, [hidden,] score)``.

All are grouped aggregates or equi-joins on bounded keys. A literal span list is mapped by a native expression; a
table of spans per sequence by an ordered sweep over the positions that occur (an as-of join), which never pairs
cells with spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ, SRC, TGT, HID, SCORE = "seq_id", "src_pos", "tgt_pos", "hidden", "score"


def squeeze(df: DataFrame, how: str = "sum") -> DataFrame:
    """Aggregate the hidden dimension to token level (``sum`` or ``l2`` norm)."""
    s = F.col(SCORE)
    agg = F.sum(s) if how == "sum" else F.sqrt(F.sum(s * s))
    return df.groupBy(SEQ, SRC, TGT).agg(agg.alias(SCORE))


def span_position(pos: Column, spans: Sequence[tuple[int, int]]) -> Column:
    """New dense position after merging each end-exclusive span into one token."""
    shift = F.lit(0)
    for start, end in spans:
        width = end - start
        shift = shift + F.when(pos >= end, width - 1).when(pos > start, pos - start).otherwise(0)
    return (pos - shift).cast("bigint")


def _agg(how: str, c: Column) -> Column:
    if how == "sum":
        return F.sum(c)
    if how == "mean":
        return F.avg(c)
    if how == "prod":
        return F.product(c)
    if how == "absmax":  # largest magnitude, the positive one on a tie
        return F.when(F.max(c) >= -F.min(c), F.max(c)).otherwise(F.min(c))
    raise ValueError(how)


def span_islands(spans: DataFrame) -> DataFrame:
    """The spans of each sequence (SEQ, ``start``, ``end``, end-exclusive) without overlaps: spans that share a position
    become one, spans that only touch stay two, and an empty, reversed or null one is none. ``before``: by how many
    positions the earlier islands of the sequence shrink it."""
    real = spans.filter("start < end").select(SEQ, "start", "end")
    order = Window.partitionBy(SEQ).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start") >= reached), 1).otherwise(0)
    numbered = real.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy(SEQ, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
    earlier = Window.partitionBy(SEQ).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return islands.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("start") - 1).over(earlier), F.lit(0)))


def span_positions(df: DataFrame, spans: DataFrame, axis: str = TGT) -> DataFrame:
    """(SEQ, ``axis``, ``position``) of every position of ``axis`` that occurs in ``df``: its place after each span of
    its sequence has become one token. One sweep per sequence over its positions and islands in order (both distinct,
    so no more than the sequence is long) finds the last island that starts at or before each position."""
    at = df.select(SEQ, F.col(axis).alias("_at")).distinct().select(
        SEQ, "_at", F.lit(1).alias("_kind"), F.lit(None).cast("struct<start:bigint,end:bigint,before:bigint>").alias("_i"))
    marks = span_islands(spans).select(SEQ, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct(
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.col("before").cast("long").alias("before")).alias("_i"))
    sweep = Window.partitionBy(SEQ).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_i", ignorenulls=True).over(sweep)
    found = at.withColumn("_at", F.col("_at").cast("long")).unionByName(marks).withColumn("_i", last).filter("_kind = 1")
    inside = F.least(F.col("_at"), F.col("_i.end") - 1) - F.col("_i.start")
    shift = F.when(F.col("_i").isNull(), 0).otherwise(F.col("_i.before") + inside)
    return found.select(SEQ, F.col("_at").alias(axis), (F.col("_at") - shift).cast("bigint").alias("position"))


def span_aggregate(df: DataFrame, spans: Sequence[tuple[int, int]] | DataFrame = ((1, 3),), how: str = "absmax",
                   axis: str = TGT) -> DataFrame:
    """Tokens inside each span become one; others keep their value. ``spans`` is one list for all sequences or a
    table (SEQ, start, end) with each sequence's own; a sequence without spans stays as it is."""
    other = [c for c in (SEQ, SRC, TGT) if c != axis]
    if isinstance(spans, DataFrame):
        place = span_positions(df, spans, axis)
        mapped = df.join(place, [SEQ, axis]).withColumn(axis, F.col("position")).drop("position")
    else:
        mapped = df.withColumn(axis, span_position(F.col(axis), spans))
    return mapped.groupBy(*other, axis).agg(_agg(how, F.col(SCORE)).alias(SCORE))


def pair_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A − b for aligned attributions, cell by cell. The keys default to the sequence, source, target
    and hidden positions present; a cell that is missing on either side, or repeated, fails the job."""
    k = list(keys) if keys else [c for c in (SEQ, SRC, TGT, HID) if c in a.columns]
    sides = a.select(*k, F.col(SCORE).alias("_s"), F.lit(1).alias("_w")).unionAll(
        b.select(*k, F.col(SCORE).alias("_s"), F.lit(-1).alias("_w")))
    cells = sides.groupBy(*k).agg(F.sum(F.col("_s") * F.col("_w")).alias("_d"), F.count(F.lit(1)).alias("_n"),
                                  F.sum("_w").alias("_b"))
    check = F.assert_true((F.col("_n") == 2) & (F.col("_b") == 0), F.lit("pair_diff: attributions are not aligned"))
    return cells.select(*k, F.when(check.isNull(), F.col("_d")).alias(SCORE))


def next_pairs(df: DataFrame, group_size: int) -> tuple[DataFrame, DataFrame]:
    """The fixture's J7 pairing: sequence s and, renumbered to s, sequence s + 1, for every s of which both are
    complete (``group_size`` target positions). Which sequences are complete is one row a sequence."""
    full = df.groupBy(SEQ).agg(F.count_distinct(TGT).alias("_n")).filter(F.col("_n") == group_size).select(SEQ)
    firsts = full.join(full.select((F.col(SEQ) - 1).alias(SEQ)), SEQ, "left_semi")
    shifted = df.withColumn(SEQ, F.col(SEQ) - 1)
    return df.join(firsts, SEQ, "left_semi"), shifted.join(firsts, SEQ, "left_semi")


def contrast_diff(pairs: DataFrame, keys: Sequence[str] = ("row_id", "step")) -> DataFrame:
    """p(chosen) − p(contrast) per step of ``pairs`` (keys…, lp_a, lp_b); steps beyond the shorter text are
    not in it."""
    return pairs.select(*keys, (F.exp("lp_a") - F.exp("lp_b")).alias("prob_diff"))


def weight_by_step(df: DataFrame, steps: DataFrame, step_key: str = TGT, weight: str = "step_score") -> DataFrame:
    """Multiply attributions by the score of their generation step."""
    keys = [SEQ, step_key] if SEQ in steps.columns else [step_key]
    return df.join(steps, keys, "inner").withColumn(SCORE, F.col(SCORE) * F.col(weight)).drop(weight)
