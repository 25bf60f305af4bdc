"""Report queries: the flagship test report (F11), scaled report (F12), metric
renaming (B11), report composition (D6) and the JSON summary round trip (A6, A7)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import sentences, sentences_joined
from glossa.operators import analysis as AN
from glossa.operators import labels as L
from glossa.operators import prep as P
from glossa.operators import textmetrics as T
from glossa.operators.textmatch import match_rows, text_rows, texts_of
from glossa.plans import model_plans, text_plans  # noqa: F401  (registers f7 first)
from glossa.plans.registry import REGISTRY, query, round_doubles
from glossa.session import shared_path
from glossa.sources import fixtures as V
from glossa.sources import io


def _ctes(sql: str) -> str:
    """The WITH part of a twin query (everything before its final SELECT)."""
    head, _, _ = sql.rpartition("\nSELECT system")
    return head


def _long(sql: str, cols: dict[str, str]) -> str:
    """Unpivot a wide twin result to (system, metric, value)."""
    names, values = ", ".join(f"'{m}'" for m in cols.values()), ", ".join(cols)
    return f"SELECT system, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM ({sql})"


_ROUGE_COLS = {f"{k}_{m}": f"test/rouge/{k}_{m}" for k in T.ROUGE_KEYS for m in ("fmeasure", "precision", "recall")}

_LABEL_SQL = V.with_views("""
, conf AS (SELECT system, reference_label, predicted_label, count(*) AS n FROM label_preds GROUP BY ALL)
SELECT system, round(sum(CASE WHEN reference_label = predicted_label THEN n ELSE 0 END) / sum(n), 6) AS acc
FROM conf GROUP BY system""".replace("\n, conf", "__X__"), "label_preds").replace("\n__X__", ",\nconf")

_CLS_LONG = "\nUNION ALL\n".join(
    f"SELECT system, '{m}' AS metric, acc AS value FROM ({_LABEL_SQL})" for m in ("test/acc", "test/f1"))
_BERT_COLS = {c: f"test/bert/{c}" for c in ("precision", "recall", "f1")}
_BERT_LONG = _long(REGISTRY["f7_text_match"].sql, _BERT_COLS)


def _texts_long(spark, sf, rouge_keys=T.ROUGE_KEYS) -> tuple[DataFrame, DataFrame]:
    """Generation metrics, and greedy match of each system's own texts to each reference, of the same stored texts."""
    rows = text_rows(V.gen_eval(spark, sf), "generated_text", "references", ["system", "row_id"])
    gen = T.generation_scores(texts_of(rows, "generated_text", "references"), by="system", rouge_keys=rouge_keys)
    return T.to_long(gen, ["system"], T.report_names(rouge_keys)), T.to_long(match_rows(rows, ["system"]), ["system"], _BERT_COLS)


def _cls_long(spark, sf) -> DataFrame:
    rep = L.label_report(V.label_preds(spark, sf), by="system")
    return T.to_long(rep.select("system", "accuracy", "f1_micro"), ["system"],
                     {"accuracy": "test/acc", "f1_micro": "test/f1"})


def test_report(spark, sf) -> DataFrame:
    gen_long, bert_long = _texts_long(spark, sf)
    return gen_long.unionByName(bert_long).unionByName(_cls_long(spark, sf)) \
        .withColumn("value", F.round("value", 6))


# the twin result of each ROUGE key
_ROUGE_SQL = {("rouge1", "rouge2"): text_plans._ROUGE_N_SQL, ("rougeL",): text_plans._ROUGE_L_SQL,
              ("rougeLsum",): text_plans._ROUGE_LSUM_SQL}
GENERATION_SQL = "\nUNION ALL\n".join([
    _long(text_plans._BLEU_SQL, {"bleu": "test/blue"}), _long(text_plans._CHRF_SQL, {"chrf": "test/chrf"}),
    *[_long(sql, {c: f"test/rouge/{c}" for c in T._rouge_cols(keys)}) for keys, sql in _ROUGE_SQL.items()]])


@query("f11_test_report", ops=("F11", "F2", "F3", "F4", "F5", "F6", "F7", "E2", "E3", "B11", "F9"),
       sql="\nUNION ALL\n".join([GENERATION_SQL, _BERT_LONG, _CLS_LONG]))
def f11_test_report(spark, sf):
    return test_report(spark, sf)


def _scaled(keys, sql: str) -> str:
    """ROUGE F-measures in per cent to 4 places, from the twin's means before they are rounded."""
    values = {f"round(100 * {k}_fmeasure, 4)": k for k in keys}
    return _long(sql.replace(", 6) AS rouge", ", 15) AS rouge"), values)


_GEN_LEN_SQL = V.with_views(f"SELECT system, round(avg(len({text_plans._ws('generated_text')})), 4) AS gen_len "
                            "FROM gen_eval GROUP BY system", "gen_eval")


@query("f12_scaled_report", ops=("F12", "C13"), sql="\nUNION ALL\n".join(
    [*[_scaled(keys, sql) for keys, sql in _ROUGE_SQL.items()], _long(_GEN_LEN_SQL, {"gen_len": "gen_len"})]))
def f12_scaled_report(spark, sf):
    return T.scaled_report(V.gen_eval(spark, sf), by="system")


@query("b11_rename_metrics", ops=("B11",), sql=f"""
SELECT system, regexp_replace(metric, '^val/', 'test/') AS metric, value FROM (
  SELECT system, replace(metric, 'test/', 'val/') AS metric, value FROM ({_CLS_LONG}))""")
def b11_rename_metrics(spark, sf):
    val = _cls_long(spark, sf).withColumn("metric", F.regexp_replace("metric", "^test/", "val/"))
    return round_doubles(P.rename_metrics(val, mapping={"val/": "test/"}))


ROUGE_N = ("rouge1", "rouge2")  # the ROUGE keys with a SQL twin; the headline has no other


_D6_PARTS = "\nUNION ALL\n".join([_long(text_plans._BLEU_SQL, {"bleu": "test/blue"}),
                                  _long(text_plans._CHRF_SQL, {"chrf": "test/chrf"}),
                                  _long(text_plans._ROUGE_N_SQL, {c: f"test/rouge/{c}" for c in T._rouge_cols(ROUGE_N)}),
                                  _BERT_LONG, _CLS_LONG])


@query("d6_compose_summary", ops=("D6",), sql=f"""
WITH parts AS ({_D6_PARTS})
SELECT system, metric, value, 'metrics' AS section FROM parts
UNION ALL
SELECT system, metric, value, 'summary' AS section FROM parts
WHERE metric IN ({", ".join(f"'{m}'" for m in AN.HEADLINE)})""")
def d6_compose_summary(spark, sf):
    out = AN.compose_summary(*_texts_long(spark, sf, ROUGE_N), _cls_long(spark, sf))
    return out.withColumn("value", F.round("value", 6))


@query("a6_a7_summary_json", ops=("A6", "A7"), sql=f"""
SELECT system AS run, metric, value FROM ({_D6_PARTS})""")
def a6_a7_summary_json(spark, sf):
    gen_long, bert_long = _texts_long(spark, sf, ROUGE_N)
    long = gen_long.unionByName(bert_long).unionByName(_cls_long(spark, sf)) \
        .withColumn("value", F.round("value", 6)).withColumnRenamed("system", "run")
    path = shared_path(spark, "summaries-" + hashlib.md5(sf.encode()).hexdigest()[:10])
    io.write_summary(long, path, headline=AN.HEADLINE)
    return io.read_summaries(spark, path + "/run=*/*.txt")


@query("g3_sentences_joined", ops=("G3",), sql=V.with_views(
    "SELECT row_id, system, array_to_string(list_filter(string_split(regexp_replace(trim(generated_text), "
    "'([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), chr(10)) AS sentences FROM gen_eval", "gen_eval"))
def g3_sentences_joined(spark, sf):
    return V.gen_eval(spark, sf).select("row_id", "system", sentences_joined("generated_text").alias("sentences"))


@query("g3_sentences", ops=("G3",), sql=V.with_views(
    "SELECT row_id, system, unnest(range(0, len(s))) AS sent_idx, unnest(s) AS sentence FROM (SELECT row_id, system, "
    "list_filter(string_split(regexp_replace(trim(generated_text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda x: x <> '') AS s FROM gen_eval)", "gen_eval"))
def g3_sentences(spark, sf):
    g = V.gen_eval(spark, sf)
    return g.select("row_id", "system", F.posexplode(sentences("generated_text")).alias("sent_idx", "sentence"))
