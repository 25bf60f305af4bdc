"""Label-quality queries over V3 (keyed, two systems) and V3L (lineitem, 600k rows at sf0.1)."""

from __future__ import annotations

from glossa.functions.labels import label_name, label_name_sql
from glossa.operators import labels as L
from glossa.plans.registry import query, round_doubles
from glossa.sources import fixtures as V

_CONF = """conf AS (SELECT {by} reference_label, predicted_label, count(*) AS n
                FROM {src} GROUP BY ALL)"""
_CLASSES = """cls AS (
  SELECT {by} label, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
    SELECT {by} reference_label AS label, CASE WHEN reference_label = predicted_label THEN n ELSE 0 END AS tp,
           n AS support, 0 AS predicted FROM conf WHERE reference_label IS NOT NULL
    UNION ALL
    SELECT {by} predicted_label AS label, 0, 0, n FROM conf WHERE predicted_label IS NOT NULL)
  GROUP BY ALL),
pcl AS (
  SELECT {by} label, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1
  FROM cls)"""


@query("b3_with_correct", ops=("B3",), sql=V.with_views(
    "SELECT *, coalesce(predicted_label = reference_label, false) AS correct FROM label_preds", "label_preds"))
def b3_with_correct(spark, sf):
    return L.with_correct(V.label_preds(spark, sf))


@query("b4_errors", ops=("B4", "A5"), sql=V.with_views(
    "SELECT * FROM label_preds WHERE NOT coalesce(predicted_label = reference_label, false)", "label_preds"))
def b4_errors(spark, sf):
    return L.errors(V.label_preds(spark, sf))


@query("b7_label_name", ops=("B7",), sql=V.with_views(
    f"""SELECT row_id, system, {label_name_sql('reference_label')} AS reference_label,
               {label_name_sql('predicted_label')} AS predicted_label FROM label_preds""", "label_preds"))
def b7_label_name(spark, sf):
    return V.label_preds(spark, sf).select(
        "row_id", "system", label_name("reference_label").alias("reference_label"),
        label_name("predicted_label").alias("predicted_label"))


@query("e1_confusion", ops=("E1",), sql=V.with_views(
    "SELECT system, reference_label, predicted_label, count(*) AS n FROM label_preds GROUP BY ALL",
    "label_preds"))
def e1_confusion(spark, sf):
    return L.confusion(V.label_preds(spark, sf), by="system")


@query("e1_confusion_lineitem", ops=("E1",), sql=V.with_views(
    "SELECT reference_label, predicted_label, count(*) AS n FROM label_preds_lineitem GROUP BY ALL",
    "label_preds_lineitem"))
def e1_confusion_lineitem(spark, sf):
    return L.confusion(V.label_preds_lineitem(spark, sf))


@query("e2_accuracy", ops=("E2",), sql=V.with_views(
    """SELECT system, round(avg(CASE WHEN coalesce(predicted_label = reference_label, false) THEN 1.0 ELSE 0.0 END), 6)
              AS accuracy, count(*) AS n FROM label_preds GROUP BY system""", "label_preds"))
def e2_accuracy(spark, sf):
    return round_doubles(L.accuracy(V.label_preds(spark, sf), by="system"))


def _with_label_ctes(view: str, body: str, by: str) -> str:
    return V.with_views(body, view).replace(
        "\n" + body, ",\n" + _CONF.format(by=by, src=view) + ",\n" + _CLASSES.format(by=by) + "\n" + body)


@query("e3_f1_micro", ops=("E3",), sql=_with_label_ctes("label_preds", """SELECT system,
    round(CASE WHEN sum(support) + sum(predicted) > 0 THEN 2 * sum(tp) / (sum(support) + sum(predicted)) ELSE 0 END, 6)
    AS f1_micro FROM cls GROUP BY system""", "system,"))
def e3_f1_micro(spark, sf):
    return round_doubles(L.f1_micro(V.label_preds(spark, sf), by="system"))


@query("e4_weighted_prf", ops=("E4",), sql=_with_label_ctes("label_preds", """SELECT system,
    round(sum(precision * support) / sum(support), 6) AS precision,
    round(sum(recall * support) / sum(support), 6) AS recall,
    round(sum(f1 * support) / sum(support), 6) AS f1 FROM pcl GROUP BY system""", "system,"))
def e4_weighted_prf(spark, sf):
    return round_doubles(L.weighted_prf(V.label_preds(spark, sf), by="system"))


@query("e4_weighted_prf_lineitem", ops=("E4",), sql=_with_label_ctes("label_preds_lineitem", """SELECT
    round(sum(precision * support) / sum(support), 6) AS precision,
    round(sum(recall * support) / sum(support), 6) AS recall,
    round(sum(f1 * support) / sum(support), 6) AS f1 FROM pcl""", ""))
def e4_weighted_prf_lineitem(spark, sf):
    return round_doubles(L.weighted_prf(V.label_preds_lineitem(spark, sf)))


@query("e5_per_class", ops=("E5",), sql=_with_label_ctes("label_preds", """SELECT system, label,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pcl""",
    "system,"))
def e5_per_class(spark, sf):
    return round_doubles(L.per_class(V.label_preds(spark, sf), by="system"))


@query("e5_per_class_lineitem", ops=("E5",), sql=_with_label_ctes("label_preds_lineitem", """SELECT label,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pcl""", ""))
def e5_per_class_lineitem(spark, sf):
    return round_doubles(L.per_class(V.label_preds_lineitem(spark, sf)))


@query("e2_e4_label_report", ops=("E2", "E3", "E4"), sql=_with_label_ctes("label_preds", """SELECT p.system,
    round(sum(precision * support) / sum(support), 6) AS precision,
    round(sum(recall * support) / sum(support), 6) AS recall,
    round(sum(f1 * support) / sum(support), 6) AS f1,
    round(any_value(a.accuracy), 6) AS accuracy, round(any_value(m.f1_micro), 6) AS f1_micro
    FROM pcl p
    JOIN (SELECT system, sum(CASE WHEN reference_label = predicted_label THEN n ELSE 0 END) / sum(n) AS accuracy
          FROM conf GROUP BY system) a ON a.system = p.system
    JOIN (SELECT system, 2 * sum(tp) / (sum(support) + sum(predicted)) AS f1_micro FROM cls GROUP BY system) m
      ON m.system = p.system
    GROUP BY p.system""", "system,"))
def e2_e4_label_report(spark, sf):
    return round_doubles(L.label_report(V.label_preds(spark, sf), by="system"))

