"""Label-quality operators.

Design: every label metric is derived from the confusion table E1, which is a
partial+final hash aggregate with at most K² output rows per group key. The
large input is scanned once; everything after the confusion step runs on a
handful of rows, so no metric rescans the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.labels import label_name  # noqa: F401  (re-export for B7)

REF, PRED = "reference_label", "predicted_label"


def _by(by: Sequence[str] | str | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def correct_expr(ref: str = REF, pred: str = PRED) -> Column:
    """True only when both labels are present and equal (a null is an error)."""
    return F.coalesce(F.col(pred) == F.col(ref), F.lit(False))


def with_correct(df: DataFrame, ref: str = REF, pred: str = PRED) -> DataFrame:
    """Add ``correct``."""
    return df.withColumn("correct", correct_expr(ref, pred))


def errors(df: DataFrame, ref: str = REF, pred: str = PRED) -> DataFrame:
    """Keep only the rows whose prediction is wrong (helper column dropped)."""
    return df.filter(~correct_expr(ref, pred))


def confusion(df: DataFrame, by=None, ref: str = REF, pred: str = PRED) -> DataFrame:
    """``(by…, reference_label, predicted_label, n)``."""
    keys = _by(by) + [ref, pred]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _class_counts(conf: DataFrame, by, ref: str, pred: str) -> DataFrame:
    """Per class (union of classes in both columns): tp, support, predicted count.

    Each confusion cell is exploded into its reference-side and prediction-side
    contribution, so the input is consumed by ONE lineage (a union of two
    filtered branches would scan the source twice)."""
    b = _by(by)
    n = F.col("n")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(ref).alias("label"), F.when(F.col(ref) == F.col(pred), n).otherwise(zero).alias("tp"),
                 n.alias("support"), zero.alias("predicted")),
        F.struct(F.col(pred).alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("predicted")))
    parts = conf.select(*b, F.explode(sides).alias("_c")).select(*b, "_c.*").filter(F.col("label").isNotNull())
    return parts.groupBy(*b, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                         F.sum("predicted").alias("predicted"))


def _ratio(num: Column, den: Column) -> Column:
    """num / den with 0/0 -> 0 (the zero-division convention of the metrics)."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def per_class(df: DataFrame, by=None, ref: str = REF, pred: str = PRED,
              from_confusion: bool = False) -> DataFrame:
    """E5: ``(by…, label, precision, recall, f1, support)``."""
    conf = df if from_confusion else confusion(df, by, ref, pred)
    cc = _class_counts(conf, by, ref, pred)
    tp, sup, pc = F.col("tp"), F.col("support"), F.col("predicted")
    return cc.select(
        *_by(by), "label",
        _ratio(tp, pc).alias("precision"),
        _ratio(tp, sup).alias("recall"),
        _ratio(2 * tp, sup + pc).alias("f1"),
        sup.alias("support"),
    )


def weighted_prf(df: DataFrame, by=None, ref: str = REF, pred: str = PRED,
                 from_confusion: bool = False) -> DataFrame:
    """Support-weighted precision, recall and F1 (weighted recall = accuracy)."""
    pcl = per_class(df, by, ref, pred, from_confusion)
    sup = F.col("support")
    w = lambda m: F.coalesce(F.try_divide(F.sum(F.col(m) * sup), F.sum(sup)), F.lit(0.0)).alias(m)
    return pcl.groupBy(*_by(by)).agg(w("precision"), w("recall"), w("f1"))


def accuracy(df: DataFrame, by=None, ref: str = REF, pred: str = PRED,
             from_confusion: bool = False) -> DataFrame:
    """Share of rows with ``correct`` (micro averaging)."""
    conf = df if from_confusion else confusion(df, by, ref, pred)
    hit = F.when(F.col(ref) == F.col(pred), F.col("n")).otherwise(0)
    return conf.groupBy(*_by(by)).agg(
        (F.sum(hit) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def f1_micro(df: DataFrame, by=None, ref: str = REF, pred: str = PRED,
             from_confusion: bool = False) -> DataFrame:
    """2·ΣTP / Σ(2TP+FP+FN) over classes; equals accuracy without nulls."""
    conf = df if from_confusion else confusion(df, by, ref, pred)
    cc = _class_counts(conf, by, ref, pred)
    return cc.groupBy(*_by(by)).agg(
        _ratio(2 * F.sum("tp"), F.sum("support") + F.sum("predicted")).alias("f1_micro"))


def label_report(df: DataFrame, by=None, ref: str = REF, pred: str = PRED) -> DataFrame:
    """E2–E4 in one pass: every metric follows from the per-class (tp, support, predicted) counts and the
    number of rows, one aggregate over the confusion table. Without any reference label the metrics are 0."""
    b, n, zero = _by(by), F.col("n"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col(ref).alias("label"), F.when(F.col(ref) == F.col(pred), n).otherwise(zero).alias("tp"),
                 n.alias("support"), zero.alias("predicted"), n.alias("rows")),
        F.struct(F.col(pred).alias("label"), zero.alias("tp"), zero.alias("support"), n.alias("predicted"), zero.alias("rows")))
    counts = confusion(df, by, ref, pred).select(*b, F.explode(sides).alias("_c")).select(*b, "_c.*") \
        .groupBy(*b, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted", "rows")])
    known = F.col("label").isNotNull()
    tp, sup, pc = (F.when(known, F.col(c)).otherwise(zero) for c in ("tp", "support", "predicted"))

    def weighted(m: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(m * sup), F.sum(sup)), F.lit(0.0))

    return counts.groupBy(*b).agg(
        weighted(_ratio(tp, pc)).alias("precision"), weighted(_ratio(tp, sup)).alias("recall"),
        weighted(_ratio(2 * tp, sup + pc)).alias("f1"),
        F.coalesce(F.try_divide(F.sum(tp), F.sum("rows")), F.lit(0.0)).alias("accuracy"),
        _ratio(2 * F.sum(tp), F.sum(sup) + F.sum(pc)).alias("f1_micro"))


# ---- logits (E6, E7) --------------------------------------------------------

def argmax(logits) -> Column:
    """0-based index of the first maximum."""
    c = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def nll_expr(logits: str, y: str) -> Column:
    """Per-row softmax cross-entropy, stable form m + log Σ exp(x − m) − x[y]."""
    x = F.col(logits)
    m = F.array_max(x)
    lse = m + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
    return lse - F.element_at(x, F.col(y) + 1)


def cross_entropy(df: DataFrame, logits: str = "logits", y: str = "y", by=None) -> DataFrame:
    """Mean cross-entropy."""
    return df.groupBy(*_by(by)).agg(F.avg(nll_expr(logits, y)).alias("cross_entropy"))
