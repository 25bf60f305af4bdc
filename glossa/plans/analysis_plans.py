"""Merge / compare / error-analysis and telemetry queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glossa.functions.labels import label_name, label_name_sql
from glossa.functions.text import count_matches, match_group
from glossa.operators import analysis as AN
from glossa.operators import batches as B
from glossa.operators import labels as L
from glossa.operators import prep as P
from glossa.operators import telemetry as TM
from glossa.plans import label_plans  # noqa: F401  (registers the label report first)
from glossa.operators.rowindex import store_ordered
from glossa.plans.registry import REGISTRY, query, round_doubles
from glossa.session import shared_path
from glossa.sources import fixtures as V

# The fixtures never contain " not " (FIXTURES §4), so the pattern queries use " the ".
THE_PATTERN = r"(.+?) (the) (.+)"


def _with(body: str, *views: str) -> str:
    return V.with_views("__BODY__", *views).replace("\n__BODY__", body)


def _sys(df, s):
    return df.filter(F.col("system") == s).drop("system")


@query("d1_zip_columns", ops=("D1",), sql=_with("""
, l AS (SELECT row_number() OVER (ORDER BY row_id, system) - 1 AS row_idx, row_id, system, generated_text
        FROM gen_eval),
r AS (SELECT row_number() OVER (ORDER BY row_id, system) - 1 AS row_idx, row_id AS label_row_id,
             system AS label_system, reference_label, predicted_label FROM label_preds)
SELECT coalesce(l.row_idx, r.row_idx) AS row_idx, row_id, system, generated_text, label_row_id, label_system,
       reference_label, predicted_label
FROM l FULL OUTER JOIN r ON l.row_idx = r.row_idx""", "gen_eval", "label_preds"))
def d1_zip_columns(spark, sf):
    """Positional concat of the two prediction files (different lengths: the outer join keeps both tails)."""
    text = V.gen_eval(spark, sf).select("row_id", "system", "generated_text")
    lab = V.label_preds(spark, sf).withColumnRenamed("row_id", "label_row_id") \
        .withColumnRenamed("system", "label_system")
    return AN.zip_columns(text, lab, ["row_id", "system"], ["label_row_id", "label_system"])


@query("d2_merge_predictions", ops=("D2", "B7", "B1"), sql=_with(f"""
SELECT g.row_id, g.system, g.input_text, g.generated_text, g."references"[1] AS reference_texts_0,
       g."references"[2] AS reference_texts_1, g."references"[3] AS reference_texts_2,
       {label_name_sql('l.predicted_label')} AS predicted_label, {label_name_sql('l.reference_label')} AS reference_label
FROM gen_eval g JOIN label_preds l ON l.row_id = g.row_id // {V.CHUNK_STRIDE} AND l.system = g.system""",
                                                            "gen_eval", "label_preds"))
def d2_merge_predictions(spark, sf):
    """Each text row meets the label row of its document (many to one)."""
    text = P.refs_to_columns(V.gen_eval(spark, sf)).withColumn("doc_id", V.doc_of())
    labels = V.label_preds(spark, sf).withColumnRenamed("row_id", "doc_id")
    return AN.merge_predictions(text, labels, ["doc_id", "system"], carry=["row_id"]).drop("doc_id")


_ERR = ("SELECT row_id FROM label_preds WHERE system = '{s}' AND NOT coalesce(reference_label = predicted_label, false)")
_D3 = f"""
, ea AS ({_ERR.format(s='A')}), eb AS ({_ERR.format(s='B')}),
d AS (SELECT row_id, 'only_a_wrong' AS kind FROM ea WHERE row_id NOT IN (SELECT row_id FROM eb)
      UNION ALL
      SELECT row_id, 'only_b_wrong' AS kind FROM eb WHERE row_id NOT IN (SELECT row_id FROM ea))"""


@query("d3_error_diff", ops=("D3",), sql=_with(_D3 + "\nSELECT row_id, kind FROM d", "label_preds"))
def d3_error_diff(spark, sf):
    lp = V.label_preds(spark, sf)
    return AN.error_diff(_sys(lp, "A"), _sys(lp, "B")).select("row_id", "kind")


@query("d3_error_diff_counts", ops=("D3",), sql=_with(_D3 + "\nSELECT kind, count(*) AS n FROM d GROUP BY kind",
                                                       "label_preds"))
def d3_error_diff_counts(spark, sf):
    lp = V.label_preds(spark, sf)
    return AN.error_diff_counts(_sys(lp, "A"), _sys(lp, "B"))


@query("d4_error_overlap", ops=("D4",), sql=_with("""
SELECT coalesce(a.reference_label = a.predicted_label, false) AS a_correct,
       coalesce(b.reference_label = b.predicted_label, false) AS b_correct, count(*) AS n
FROM label_preds a JOIN label_preds b ON a.row_id = b.row_id AND a.system = 'A' AND b.system = 'B'
GROUP BY ALL""", "label_preds"))
def d4_error_overlap(spark, sf):
    lp = V.label_preds(spark, sf)
    return AN.error_overlap(_sys(lp, "A"), _sys(lp, "B"))


LABEL_METRICS = ("precision", "recall", "f1", "accuracy", "f1_micro")
_D5_LONG = "\nUNION ALL\n".join(f"SELECT system, '{m}' AS metric, {m} AS value FROM rep" for m in LABEL_METRICS)


@query("d5_compare_runs", ops=("D5",), sql=f"""
WITH rep AS ({REGISTRY["e2_e4_label_report"].sql}),
long AS ({_D5_LONG}),
wide AS (SELECT metric, max(value) FILTER (WHERE system = 'A') AS a, max(value) FILTER (WHERE system = 'B') AS b
         FROM long GROUP BY metric)
SELECT metric, round(a, 6) AS value_a, round(b, 6) AS value_b, round(b - a, 6) AS delta FROM wide""")
def d5_compare_runs(spark, sf):
    rep = round_doubles(L.label_report(V.label_preds(spark, sf), by="system")).withColumnRenamed("system", "run")
    return round_doubles(AN.compare_runs(rep.unpivot("run", list(LABEL_METRICS), "metric", "value"), "A", "B"))


@query("e10_prevalence", ops=("E10", "G1"), sql=_with(f"""
, j AS (SELECT g.system, g.generated_text, coalesce(l.reference_label = l.predicted_label, false) AS ok
        FROM gen_eval g JOIN label_preds l ON l.row_id = g.row_id // {V.CHUNK_STRIDE} AND l.system = g.system),
c AS (SELECT system, ok, len(regexp_extract_all(generated_text, '{THE_PATTERN}')) AS m FROM j)
SELECT system, 'all' AS scope, sum(m) AS matches, count(*) AS rows, round(sum(m) / count(*), 6) AS rate
FROM c GROUP BY system
UNION ALL
SELECT system, 'errors', coalesce(sum(m) FILTER (WHERE NOT ok), 0), count(*) FILTER (WHERE NOT ok),
       round(CASE WHEN count(*) FILTER (WHERE NOT ok) > 0
                  THEN coalesce(sum(m) FILTER (WHERE NOT ok), 0) / count(*) FILTER (WHERE NOT ok) END, 6)
FROM c GROUP BY system""", "gen_eval", "label_preds"))
def e10_prevalence(spark, sf):
    text = V.gen_eval(spark, sf).select(V.doc_of().alias("doc_id"), "system", "generated_text")
    labels = V.label_preds(spark, sf).withColumnRenamed("row_id", "doc_id")
    return round_doubles(AN.prevalence_keyed(text, labels, ["doc_id", "system"], "generated_text", THE_PATTERN,
                                             by="system"))


@query("g1_count_matches", ops=("G1",), sql=V.with_views(
    f"SELECT row_id, system, len(regexp_extract_all(generated_text, '{THE_PATTERN}')) AS n FROM gen_eval", "gen_eval"))
def g1_count_matches(spark, sf):
    return V.gen_eval(spark, sf).select("row_id", "system",
                                        count_matches("generated_text", THE_PATTERN).alias("n"))


@query("g2_match_groups", ops=("G2",), sql=V.with_views(
    "SELECT row_id, system, " + ", ".join(
        f"regexp_extract(generated_text, '{THE_PATTERN}', {i}) AS {n}" for i, n in
        ((1, "before"), (2, "cue"), (3, "after"))) + " FROM gen_eval", "gen_eval"))
def g2_match_groups(spark, sf):
    return V.gen_eval(spark, sf).select(
        "row_id", "system", *[match_group("generated_text", i, THE_PATTERN).alias(n)
                              for i, n in ((1, "before"), (2, "cue"), (3, "after"))])


# ---- H / E8 -----------------------------------------------------------------------

@query("h1_sample_n", ops=("H1", "B7"), sql=V.with_views(f"""
SELECT row_id, {label_name_sql('label')} AS label_name, premise, hypothesis FROM nli WHERE split = 'train'
ORDER BY md5(CAST(row_id AS VARCHAR) || '42'), row_id LIMIT 20""", "nli"))
def h1_sample_n(spark, sf):
    train = V.nli(spark, sf).filter(F.col("split") == "train")  # the split the reference inspects
    s = TM.sample_n(train, 20, 42)
    return s.select("row_id", label_name("label").alias("label_name"), "premise", "hypothesis")


@query("h2_head", ops=("H2",), sql=V.with_views(
    "SELECT row_id, system, generated_text FROM gen_eval ORDER BY row_id, system LIMIT 10", "gen_eval"))
def h2_head(spark, sf):
    return TM.head(V.gen_eval(spark, sf).select("row_id", "system", "generated_text"), 10, ["row_id", "system"])


@query("h3_row_at", ops=("H3",), sql=V.with_views("""
SELECT * FROM (SELECT row_id, premise, row_number() OVER (ORDER BY row_id) - 1 AS row_idx FROM nli
               WHERE split = 'test') WHERE row_idx = 5""", "nli"))
def h3_row_at(spark, sf):
    test = V.nli(spark, sf).filter(F.col("split") == "test").select("row_id", "premise")
    # an epoch's order is stored once; every later position reads one file of it
    table = store_ordered(test, ["row_id"], shared_path(spark, f"ordered-{uuid.uuid4().hex}"))
    return TM.row_at(table, 5)


SAMPLE_TEXTS = ("input_text", "generated_text", "reference_text_1", "reference_text_2", "reference_text_3")


def sample_rows(spark, sf):
    """The columns of the sample log: keys, input, generated text and three references."""
    return V.gen_eval(spark, sf).select("row_id", "system", "input_text", "generated_text", *[
        F.col("references")[i].alias(f"reference_text_{i + 1}") for i in range(3)])


@query("h4_sample_batches", ops=("H4",), sql=V.with_views(f"""
SELECT row_id, system, row_idx, batch_id, {", ".join(SAMPLE_TEXTS)} FROM (
  SELECT *, idx AS row_idx, idx // 8 AS batch_id, idx % 8 AS pos
  FROM (SELECT row_id, system, input_text, generated_text, "references"[1] AS reference_text_1,
               "references"[2] AS reference_text_2, "references"[3] AS reference_text_3,
               row_number() OVER (ORDER BY row_id, system) - 1 AS idx FROM gen_eval))
WHERE (batch_id + 1) % 5 = 0 AND pos < 3""", "gen_eval"))
def h4_sample_batches(spark, sf):
    keys = sample_rows(spark, sf).select("row_id", "system")  # only the keys are numbered
    picked = TM.sample_batches(B.assign_batches(keys, ["row_id", "system"], 8), 5, 3)
    return picked.join(sample_rows(spark, sf), ["row_id", "system"])


def _whole_log(spark, sf):
    return V.step_log(spark, sf).withColumn("run", F.lit("all"))


@query("h5_bucket_mean", ops=("H5",), sql=V.with_views("""
SELECT 'all' AS run, bucket * 50 AS step, round(avg(loss), 6) AS loss_reduced
FROM (SELECT greatest(CAST(ceil(step / 50) AS BIGINT), 1) AS bucket, step, loss FROM step_log)
GROUP BY bucket HAVING max(step) = bucket * 50""", "step_log"))
def h5_bucket_mean(spark, sf):
    return round_doubles(TM.bucket_mean(_whole_log(spark, sf), 50))


@query("h6_best_checkpoint", ops=("H6",), sql=V.with_views("""
SELECT 'all' AS run, step, loss FROM step_log WHERE step % 500 = 0 ORDER BY loss, step LIMIT 1""", "step_log"))
def h6_best_checkpoint(spark, sf):
    return TM.best_checkpoint(_whole_log(spark, sf), 500)


@query("h7_validation_points", ops=("H7", "C12"), sql=V.with_views("""
SELECT step, loss, step // 1000 AS point FROM step_log WHERE step % 1000 = 0 AND step // 1000 < 5""", "step_log"))
def h7_validation_points(spark, sf):
    return TM.validation_points(_whole_log(spark, sf), 1000, 5).select("step", "loss", "point")


@query("e8_epoch_mean", ops=("E8",), sql=V.with_views(
    "SELECT epoch, round(sum(loss * n) / sum(n), 6) AS loss_epoch FROM step_log GROUP BY epoch", "step_log"))
def e8_epoch_mean(spark, sf):
    return round_doubles(TM.epoch_mean(V.step_log(spark, sf)))
