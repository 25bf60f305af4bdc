"""Merging, comparing and error analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.labels import label_name
from glossa.functions.text import NEGATION_PATTERN, count_matches
from glossa.operators.labels import correct_expr
from glossa.operators.rowindex import dense_index

# Headline keys of the complete report.
HEADLINE = ("test/chrf", "test/rouge/rouge1_fmeasure", "test/rouge/rouge2_fmeasure", "test/bert/f1",
            "test/acc", "test/f1")
EXPORT_ORDER = ("input_text", "generated_text", "reference_texts_0", "reference_texts_1", "reference_texts_2",
                "predicted_label", "reference_label")


def zip_columns(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str],
                index: str = "row_idx") -> DataFrame:
    """Positional concat (pandas ``axis=1``): both sides get a dense index in
    their explicit order (§4.3), then a full outer equi-join on it."""
    li = dense_index(left, list(left_order), index)
    ri = dense_index(right, list(right_order), index)
    return li.join(ri, index, "full_outer")


def merge_predictions(text: DataFrame, labels: DataFrame, key: Sequence[str] | str = "row_id",
                      carry: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Keyed merge of text and label predictions, labels decoded to names,
    columns in the export order (key columns first, then ``carry``). ``how="left"``
    keeps texts without a label (null names, which E1–E4 count as errors)."""
    keys = [key] if isinstance(key, str) else list(key)
    j = text.join(labels, keys, how)
    j = j.withColumn("predicted_label", label_name("predicted_label")) \
        .withColumn("reference_label", label_name("reference_label"))
    rest = [c for c in EXPORT_ORDER if c in j.columns]
    return j.select(*keys, *carry, *rest)


def error_diff(a: DataFrame, b: DataFrame, key: Sequence[str] | str = "row_id") -> DataFrame:
    """D3: rows A gets wrong but B right (``only_a_wrong``) and the reverse.

    One pass: the two error sets are tagged, unioned and grouped by key (at most
    two rows per key); a key wrong on exactly one side is kept. Each input is
    read once and no key can be hot."""
    keys = [key] if isinstance(key, str) else list(key)
    ea = a.filter(~correct_expr()).select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    eb = b.filter(~correct_expr()).select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    g = ea.unionByName(eb).groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return g.filter(F.col("_a") != F.col("_b")).select(
        *keys, F.when(F.col("_a") == 1, F.lit("only_a_wrong")).otherwise(F.lit("only_b_wrong")).alias("kind"))


def error_diff_counts(a: DataFrame, b: DataFrame, key="row_id") -> DataFrame:
    return error_diff(a, b, key).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def error_overlap(a: DataFrame, b: DataFrame, key: Sequence[str] | str = "row_id") -> DataFrame:
    """Agreement table (both right / only A wrong / only B wrong / both wrong)."""
    keys = [key] if isinstance(key, str) else list(key)
    ca = a.select(*keys, correct_expr().alias("a_correct"))
    cb = b.select(*keys, correct_expr().alias("b_correct"))
    return ca.join(cb, keys, "inner").groupBy("a_correct", "b_correct").agg(F.count(F.lit(1)).alias("n"))


def compare_runs(summaries: DataFrame, a: str, b: str, run: str = "run", metric: str = "metric",
                 value: str = "value") -> DataFrame:
    """Metric by metric, run a vs run b and the delta b − a."""
    p = summaries.groupBy(metric).pivot(run, [a, b]).agg(F.first(value))
    return p.select(metric, F.col(a).alias("value_a"), F.col(b).alias("value_b"),
                    (F.col(b) - F.col(a)).alias("delta"))


def compose_summary(*parts: DataFrame, headline: Sequence[str] = HEADLINE) -> DataFrame:
    """Union of long-form summaries plus the headline subset (``section``)."""
    allm = parts[0]
    for p in parts[1:]:
        allm = allm.unionByName(p)
    full = allm.withColumn("section", F.lit("metrics"))
    head = allm.filter(F.col("metric").isin(*headline)).withColumn("section", F.lit("summary"))
    return full.unionByName(head)


def prevalence(df: DataFrame, text: str = "generated_text", pattern: str = NEGATION_PATTERN,
               by: Sequence[str] | str = ()) -> DataFrame:
    """Matches / rows for all rows and for the wrong rows (a ratio, not %).
    ``count(*)`` counts rows with null text, as ``len()`` does."""
    keys = [by] if isinstance(by, str) else list(by)
    per_row = df.select(*keys, count_matches(text, pattern).alias("_m"), F.lit(1).cast("bigint").alias("_n"),
                        (~correct_expr()).alias("_wrong"))
    return _prevalence(per_row, keys)


def prevalence_keyed(texts: DataFrame, labels: DataFrame, keys: Sequence[str], text: str = "generated_text",
                     pattern: str = NEGATION_PATTERN, by: Sequence[str] | str = ()) -> DataFrame:
    """E10 when many text rows share one label row (joined on ``keys``): the text
    side is reduced to (keys → matches, rows) before the join, so the join and its
    shuffle carry one row per key and a key holding a third of the texts is one
    partial row per task. Same result as joining first."""
    group = [by] if isinstance(by, str) else list(by)
    t = texts.groupBy(*keys).agg(F.sum(count_matches(text, pattern)).alias("_m"), F.count(F.lit(1)).alias("_n"))
    per_key = t.join(labels, list(keys)).select(*group, "_m", "_n", (~correct_expr()).alias("_wrong"))
    return _prevalence(per_key, group)


def _prevalence(df: DataFrame, keys: list[str]) -> DataFrame:
    wrong = F.col("_wrong")
    return df.groupBy(*keys).agg(
        F.sum("_m").alias("matches_all"), F.sum("_n").alias("rows_all"),
        F.sum(F.when(wrong, F.col("_m"))).alias("matches_errors"),
        F.coalesce(F.sum(F.when(wrong, F.col("_n"))), F.lit(0).cast("bigint")).alias("rows_errors"),
    ).select(
        *keys, F.explode(F.array(
            F.struct(F.lit("all").alias("scope"), F.col("matches_all").alias("matches"),
                     F.col("rows_all").alias("rows")),
            F.struct(F.lit("errors").alias("scope"), F.coalesce("matches_errors", F.lit(0)).alias("matches"),
                     F.col("rows_errors").alias("rows")))).alias("s")
    ).select(*keys, "s.scope", "s.matches", "s.rows",
             F.expr("try_divide(s.matches, s.rows)").cast("double").alias("rate"))
