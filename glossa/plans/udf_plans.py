"""User-function queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators import lm
from glossa.operators import prep as P
from glossa.operators import udf as U
from glossa.plans import model_plans
from glossa.plans.registry import query, round_doubles
from glossa.sources import fixtures as V

_TOK = r"list_filter(regexp_split_to_array(trim({s}), '\s+'), lambda x: x <> '')"


@query("j1_batch_infer", ops=("J1",), sql=V.with_views(f"""
SELECT row_id, 'premise: ' || premise || chr(10) || 'hypothesis: ' || hypothesis AS input_text,
       array_to_string(list_filter({_TOK.format(s='hypothesis')}, lambda x, i: (i - 1) % 7 <> 6), ' ')
         AS generated_text,
       [explanation_1, explanation_2, explanation_3] AS "references"
FROM nli WHERE split = 'test'""", "nli"))
def j1_batch_infer(spark, sf):
    test = V.nli(spark, sf).filter(F.col("split") == "test").select(
        "row_id", P.input_text().alias("input_text"),
        F.array("explanation_1", "explanation_2", "explanation_3").alias("references"))
    return U.batch_infer(test, lambda: U.token_drop_model(7), batch_size=32)


_K1_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("input_text", T.StringType()),
                           T.StructField("target", T.StringType())])


def _template_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """A user batch function in the reference's style: column-wise templating."""
    out = pdf.copy()
    out["input_text"] = "premise: " + pdf["premise"] + "\nhypothesis: " + pdf["hypothesis"]
    out["target"] = pdf["label"].astype(str) + " \n " + pdf["explanation_1"]
    return out


@query("k1_map_batches", ops=("K1",), sql=V.with_views("""
SELECT row_id, 'premise: ' || premise || chr(10) || 'hypothesis: ' || hypothesis AS input_text,
       CAST(label AS VARCHAR) || ' ' || chr(10) || ' ' || explanation_1 AS target FROM nli""", "nli"))
def k1_map_batches(spark, sf):
    nli = V.nli(spark, sf).select("row_id", "premise", "hypothesis", "label", "explanation_1")
    return U.map_batches(nli, _template_batch, _K1_SCHEMA,
                         drop=["premise", "hypothesis", "label", "explanation_1"])


def _k2_sql(step: str) -> str:
    return model_plans._with(model_plans._lm_sql(a="explanation_1", b="explanation_2") + f"""
, d AS (SELECT row_id, {step} AS step, exp(a.logprob) - exp(b.logprob) AS v
        FROM lp_a a JOIN lp_b b USING (row_id, step))
SELECT row_id, step, round(product(v), 6) AS prob_diff FROM d GROUP BY ALL""", "nli")


def _prob_diff(spark, sf, aggregate, spans):
    U.register_metric(spark, "prob_diff", [("lp_a", "DOUBLE"), ("lp_b", "DOUBLE")], "exp(lp_a) - exp(lp_b)",
                      aggregate=aggregate)
    nli = V.nli(spark, sf)
    model = lm.fit_bigram(nli.filter(F.col("split") == "train"), "explanation_1")
    test = nli.filter(F.col("split") == "test")
    steps = lm.score_bigram_pair(test, "explanation_1", "explanation_2", model)
    return round_doubles(U.apply_metric(steps, "prob_diff", ["lp_a", "lp_b"], ["row_id"], "step", spans))


@query("k2_register_metric", ops=("K2", "J6", "J8"),
       sql=_k2_sql("CASE WHEN step >= 3 THEN step - 1 WHEN step > 1 THEN 1 ELSE step END"))
def k2_register_metric(spark, sf):
    return _prob_diff(spark, sf, "prod", [(1, 3)])


PRODUCT = U.UserAggregate(zero=lambda: [1.0], update=lambda s, v: [s[0] * float(np.prod(v))],
                          merge=lambda a, b: [a[0] * b[0]], finish=lambda s: s[0])


@query("k2_user_aggregate", ops=("K2",), sql=_k2_sql("CASE WHEN step >= 9 THEN step - 7 WHEN step > 1 THEN 1 ELSE step END"))
def k2_user_aggregate(spark, sf):
    """The user's own product, given as zero, update, merge and finish, over a span of eight steps."""
    return _prob_diff(spark, sf, PRODUCT, [(1, 9)])


@query("k2_user_function", ops=("K2",), sql=_k2_sql("CASE WHEN step >= 3 THEN step - 1 WHEN step > 1 THEN 1 ELSE step END"))
def k2_user_function(spark, sf):
    """The user's own function of a span's values."""
    return _prob_diff(spark, sf, lambda values: float(np.prod(values)), [(1, 3)])
