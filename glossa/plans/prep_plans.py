"""Preparation, batching and I/O queries (A1–A8, B1, B2, B5, B6, B8–B10, C1–C14) over V1–V4."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from glossa.operators import batches as B
from glossa.operators import labels as L
from glossa.operators import prep as P
from glossa.operators import tokens as TK
from glossa.operators.rowindex import store_ordered
from glossa.plans.registry import REGISTRY, query
from glossa.session import shared_path
from glossa.sources import fixtures as V
from glossa.sources import io

VOCAB_SIZE = 4000      # fixture parameter of C1
SHORT = 16             # fixture budget for C3/C4 so truncation and padding both occur
BATCH = 16
SEED = 42


def _with(body: str, *views: str) -> str:
    return V.with_views("__BODY__", *views).replace("\n__BODY__", body)


_TOK = r"list_filter(regexp_split_to_array(trim({s}), '\s+'), lambda x: x <> '')"


def _tok(s: str) -> str:
    return _TOK.format(s=s)


def _trunc(x: str, n: int) -> str:
    return f"(CASE WHEN len({x}) > {n} THEN ({x})[1:{n - 1}] || [1] ELSE {x} END)"


def _pad(x: str, n: int, v: int = 0) -> str:
    return f"({x} || list_transform(range(0, greatest({n} - len({x}), 0)), lambda z: {v}))"


_VOCAB_CTE = f"""
, vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token ASC) + 2 AS INTEGER) AS id
  FROM (SELECT token, count(*) AS n
        FROM (SELECT unnest(flatten([{_tok('premise')}, {_tok('hypothesis')}, {_tok('explanation_1')},
                                     {_tok('explanation_2')}, {_tok('explanation_3')}])) AS token
              FROM nli WHERE split = 'train')
        GROUP BY token)
  ORDER BY n DESC, token ASC LIMIT {VOCAB_SIZE})"""

_TEMPLATE_SQL = "'premise: ' || premise || chr(10) || 'hypothesis: ' || hypothesis"

# long-form encoding of the four texts of every V1 row: field 0 = input, 1..3 = explanations
_ENC_CTE = _VOCAB_CTE + f""",
lf AS (SELECT row_id, unnest([{_TEMPLATE_SQL}, explanation_1, explanation_2, explanation_3]) AS text,
              unnest(range(0, 4)) AS field FROM nli),
lt AS (SELECT row_id, field, unnest({_tok('text')}) AS token, unnest(range(1, len({_tok('text')}) + 1)) AS pos
       FROM lf),
lj AS (SELECT row_id, field, list(coalesce(v.id, 2) ORDER BY pos) AS ids
       FROM lt LEFT JOIN vocab v USING (token) GROUP BY ALL),
raw AS (SELECT n.row_id, n.split, n.label,
               coalesce(max(ids) FILTER (WHERE field = 0), []) || [1] AS f0,
               coalesce(max(ids) FILTER (WHERE field = 1), []) || [1] AS f1,
               coalesce(max(ids) FILTER (WHERE field = 2), []) || [1] AS f2,
               coalesce(max(ids) FILTER (WHERE field = 3), []) || [1] AS f3
        FROM nli n LEFT JOIN lj USING (row_id) GROUP BY ALL),
prepared AS (SELECT row_id, split, {_trunc('f0', 512)} AS input_ids,
                    list_transform({_trunc('f0', 512)}, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END) AS attention_mask,
                    label AS int_labels, {_trunc('f1', 128)} AS labels,
                    CASE WHEN split <> 'train' THEN {_pad(_trunc('f1', 128), 128)} END AS explanation_1,
                    CASE WHEN split <> 'train' THEN {_pad(_trunc('f2', 128), 128)} END AS explanation_2,
                    CASE WHEN split <> 'train' THEN {_pad(_trunc('f3', 128), 128)} END AS explanation_3
             FROM raw)"""


def _vocab(spark, sf):
    nli = V.nli(spark, sf)
    return TK.build_vocab(nli.filter(F.col("split") == "train"),
                          ["premise", "hypothesis", "explanation_1", "explanation_2", "explanation_3"], VOCAB_SIZE)


def _prepared(spark, sf):
    return B.prepare(V.nli(spark, sf), _vocab(spark, sf))


def _hyp_ids(spark, sf, max_len=512):
    return TK.encode(V.nli(spark, sf), "hypothesis", _vocab(spark, sf), max_len, out="ids")


# ---- B ----------------------------------------------------------------------

@query("b1_select_cols", ops=("B1",), sql=V.with_views(
    "SELECT predicted_label, reference_label, row_id, system FROM label_preds", "label_preds"))
def b1_select_cols(spark, sf):
    return P.select_cols(V.label_preds(spark, sf), ["predicted_label", "reference_label", "row_id", "system"])


@query("b2_drop_cols", ops=("B2",), sql=V.with_views(
    "SELECT * EXCLUDE (explanation_2, explanation_3) FROM nli", "nli"))
def b2_drop_cols(spark, sf):
    return P.drop_cols(V.nli(spark, sf), ["explanation_2", "explanation_3"])


for _style, _sql in (("canonical", _TEMPLATE_SQL),
                     ("spaced_plural", "'premise: ' || premise || ' ' || chr(10) || ' hypotheses: ' || hypothesis"),
                     ("spaced", "'premise: ' || premise || ' ' || chr(10) || ' hypothesis: ' || hypothesis")):
    def _mk(style):
        def run(spark, sf):
            return V.nli(spark, sf).select("row_id", P.input_text(style=style).alias("input_text"))
        return run
    query(f"b5_template_{_style}", ops=("B5",),
          sql=V.with_views(f"SELECT row_id, {_sql} AS input_text FROM nli", "nli"))(_mk(_style))


@query("b6_template_target_1", ops=("B6",), sql=V.with_views(
    "SELECT row_id, CAST(label AS VARCHAR) || ' ' || chr(10) || ' ' || explanation_1 AS target FROM nli", "nli"))
def b6_template_target_1(spark, sf):
    return P.template_target(V.nli(spark, sf), 1).select("row_id", "target")


@query("b6_template_target_3", ops=("B6",), sql=V.with_views("SELECT row_id, " + ", ".join(
    f"CAST(label AS VARCHAR) || ' ' || chr(10) || ' ' || explanation_{i} AS target_{i}" for i in (1, 2, 3))
    + " FROM nli WHERE split <> 'train'", "nli"))
def b6_template_target_3(spark, sf):
    nli = V.nli(spark, sf).filter(F.col("split") != "train")
    return P.template_target(nli, 3).select("row_id", "target_1", "target_2", "target_3")


@query("b8_prepare", ops=("B8", "B5", "C2", "C3", "C4", "C5", "K1"), sql=_with(_ENC_CTE + """
SELECT * FROM prepared""", "nli"))
def b8_prepare(spark, sf):
    return _prepared(spark, sf)


@query("b9_refs_to_columns", ops=("B9",), sql=V.with_views(
    'SELECT row_id, system, input_text, generated_text, "references"[1] AS reference_texts_0, '
    '"references"[2] AS reference_texts_1, "references"[3] AS reference_texts_2 FROM gen_eval', "gen_eval"))
def b9_refs_to_columns(spark, sf):
    return P.refs_to_columns(V.gen_eval(spark, sf))


@query("b9_refs_roundtrip", ops=("B9",), sql=V.with_views(
    'SELECT row_id, system, "references" FROM gen_eval', "gen_eval"))
def b9_refs_roundtrip(spark, sf):
    cols = P.refs_to_columns(V.gen_eval(spark, sf).select("row_id", "system", "references"))
    return P.refs_to_array(cols)


@query("b10_unbatch", ops=("B10", "C7"), sql=V.with_views("""
SELECT idx // 8 AS batch_id, idx % 8 AS pos_in_batch, row_id, system, generated_text
FROM (SELECT row_id, system, generated_text, row_number() OVER (ORDER BY row_id, system) - 1 AS idx FROM gen_eval)""",
                                                           "gen_eval"))
def b10_unbatch(spark, sf):
    g = V.gen_eval(spark, sf).select("row_id", "system", "generated_text")
    cols = ["row_id", "system", "generated_text"]
    batched = P.batch_arrays(B.assign_batches(g, ["row_id", "system"], 8), "batch_id", "row_idx", cols)
    return P.unbatch(batched, "batch_id", cols)


# ---- C ------------------------------------------------------------------------

@query("c1_build_vocab", ops=("C1",), sql=_with(_VOCAB_CTE + "\nSELECT token, id FROM vocab", "nli"))
def c1_build_vocab(spark, sf):
    return _vocab(spark, sf)


_HYP_CTE = _VOCAB_CTE + f""",
e AS (SELECT row_id, unnest({_tok('hypothesis')}) AS token, unnest(range(1, len({_tok('hypothesis')}) + 1)) AS pos
      FROM nli),
j AS (SELECT e.row_id, e.pos, e.token, v.id AS vid FROM e LEFT JOIN vocab v USING (token)),
h AS (SELECT n.row_id, coalesce((SELECT list(coalesce(vid, 2) ORDER BY pos) FROM j WHERE j.row_id = n.row_id), [])
             || [1] AS ids FROM nli n)"""


@query("c2_encode", ops=("C2",), sql=_with(_HYP_CTE + f"\nSELECT row_id, {_trunc('ids', 512)} AS ids FROM h", "nli"))
def c2_encode(spark, sf):
    return _hyp_ids(spark, sf)


@query("c3_truncate", ops=("C3",), sql=_with(_HYP_CTE + f"\nSELECT row_id, {_trunc('ids', SHORT)} AS ids FROM h",
                                                 "nli"))
def c3_truncate(spark, sf):
    return _hyp_ids(spark, sf).select("row_id", TK.truncate("ids", SHORT).alias("ids"))


@query("c4_pad_fixed", ops=("C4",), sql=_with(
    _HYP_CTE + f"\nSELECT row_id, {_pad(_trunc('ids', SHORT), SHORT)} AS ids FROM h", "nli"))
def c4_pad_fixed(spark, sf):
    return _hyp_ids(spark, sf).select("row_id", TK.pad_fixed(TK.truncate("ids", SHORT), SHORT).alias("ids"))


@query("c5_attention_mask", ops=("C5",), sql=_with(_HYP_CTE + f"""
SELECT row_id, list_transform({_pad(_trunc('ids', 512), 64)}, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END)
       AS attention_mask FROM h""",
                                                         "nli"))
def c5_attention_mask(spark, sf):
    return _hyp_ids(spark, sf).select("row_id", TK.attention_mask(TK.pad_fixed("ids", 64)).alias("attention_mask"))


@query("c6_decode", ops=("C6",), sql=_with(_HYP_CTE + """
SELECT n.row_id, coalesce((SELECT array_to_string(list(token ORDER BY pos), ' ') FROM j
                           WHERE j.row_id = n.row_id AND vid IS NOT NULL AND pos <= 511), '') AS text
FROM nli n""", "nli"))
def c6_decode(spark, sf):
    vocab = _vocab(spark, sf)
    table = TK.vocab_table(vocab)  # measured and gathered once for both directions
    ids = TK.encode(V.nli(spark, sf), "hypothesis", vocab, 512, out="ids", table=table)
    return TK.decode(ids, "ids", vocab, out="text", table=table)


@query("c7_assign_batches", ops=("C7",), sql=V.with_views("""
SELECT row_id, system, idx AS row_idx, idx // 32 AS batch_id
FROM (SELECT row_id, system, row_number() OVER (ORDER BY row_id, system) - 1 AS idx FROM gen_eval)""", "gen_eval"))
def c7_assign_batches(spark, sf):
    g = V.gen_eval(spark, sf).select("row_id", "system")
    return B.assign_batches(g, ["row_id", "system"], 32)


_BATCHED_CTE = _ENC_CTE + f""",
bt AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // {BATCH} AS batch_id FROM prepared),
col AS (SELECT row_id, batch_id,
               {_pad('input_ids', 'max(len(input_ids)) OVER (PARTITION BY batch_id)')} AS input_ids,
               {_pad('attention_mask', 'max(len(attention_mask)) OVER (PARTITION BY batch_id)')} AS attention_mask,
               {_pad('labels', 'max(len(labels)) OVER (PARTITION BY batch_id)', -100)} AS labels
        FROM bt)"""


def _collated(spark, sf):
    rows = _prepared(spark, sf).select("row_id", "input_ids", "attention_mask", "labels")
    return B.collate(B.assign_batches(rows, ["row_id"], BATCH).drop("row_idx"))


@query("c8_collate", ops=("C8",), sql=_with(_BATCHED_CTE + "\nSELECT * FROM col", "nli"))
def c8_collate(spark, sf):
    return _collated(spark, sf)


@query("c9_mask_labels", ops=("C9",), sql=_with(_BATCHED_CTE + """
SELECT row_id, list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END) AS unmasked,
       list_transform(list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END),
                      lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS masked
FROM col""", "nli"))
def c9_mask_labels(spark, sf):
    c = _collated(spark, sf)
    return c.select("row_id", TK.unmask_labels("labels").alias("unmasked"),
                    TK.mask_labels(TK.unmask_labels("labels")).alias("masked"))


@query("c10_shift_right", ops=("C10",), sql=_with(_BATCHED_CTE + """
, u AS (SELECT row_id, list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END) AS l FROM col)
SELECT row_id, CASE WHEN len(l) = 0 THEN l ELSE [0] || l[1:len(l) - 1] END AS decoder_input_ids FROM u""", "nli"))
def c10_shift_right(spark, sf):
    return _collated(spark, sf).select("row_id", TK.shift_right("labels").alias("decoder_input_ids"))


@query("c11_shuffle", ops=("C11",), sql=V.with_views(f"""
SELECT row_id, row_number() OVER (ORDER BY md5(CAST(row_id AS VARCHAR) || '{SEED}'), row_id) - 1 AS shuffle_idx
FROM nli WHERE split = 'train'""", "nli"))
def c11_shuffle(spark, sf):
    train = V.nli(spark, sf).filter(F.col("split") == "train").select("row_id")
    return B.shuffle_order(train, "row_id", SEED)


@query("c12_limit_batches", ops=("C12",), sql=V.with_views("""
SELECT row_id, system, idx AS row_idx, idx // 32 AS batch_id
FROM (SELECT row_id, system, row_number() OVER (ORDER BY row_id, system) - 1 AS idx FROM gen_eval)
WHERE idx // 32 < 3""", "gen_eval"))
def c12_limit_batches(spark, sf):
    """The first k batches is the operator itself (the reference's limit_*_batches)."""
    g = V.gen_eval(spark, sf).select("row_id", "system")
    return B.limit_batches(B.assign_batches(g, ["row_id", "system"], 32), 3)


@query("c12_first_batches_stored", ops=("C12",), sql=REGISTRY["c12_limit_batches"].sql)
def c12_first_batches_stored(spark, sf):
    """The same batches from a table stored in order: only the files of those positions are read."""
    g = V.gen_eval(spark, sf).select("row_id", "system")
    table = store_ordered(g, ["row_id", "system"], shared_path(spark, f"ordered-{uuid.uuid4().hex}"))
    return B.first_batches(table, 3, 32)


@query("c13_gen_len", ops=("C13",), sql=_with(_BATCHED_CTE + """
SELECT round(avg(len(list_filter(list_transform(labels, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END),
                                 lambda x: x <> 0))), 4) AS gen_len FROM col""", "nli"))
def c13_gen_len(spark, sf):
    return TK.gen_len(_collated(spark, sf).withColumn("labels", TK.unmask_labels("labels")), "labels")


@query("c14_batch_shapes", ops=("C14",), sql=_with(_BATCHED_CTE + """
SELECT batch_id, count(*) AS rows, max(len(input_ids)) AS input_width, max(len(labels)) AS label_width
FROM col GROUP BY batch_id""", "nli"))
def c14_batch_shapes(spark, sf):
    return B.batch_shapes(_collated(spark, sf))


# ---- A ------------------------------------------------------------------------

def _tag(sf: str) -> str:
    return hashlib.md5(sf.encode()).hexdigest()[:10]


def _nli_for_io(spark, sf):
    return V.nli(spark, sf).select(*[f.name for f in io.NLI_SCHEMA.fields])


@query("a2_cached_nli", ops=("A2",), sql=V.with_views(
    "SELECT row_id, premise, hypothesis, label, explanation_1, explanation_2, explanation_3, split FROM nli", "nli"))
def a2_cached_nli(spark, sf):
    path = shared_path(spark, f"nli-{_tag(sf)}")
    return io.cached(spark, path, lambda: _nli_for_io(spark, sf), schema=io.NLI_SCHEMA)


@query("a1_read_splits", ops=("A1",), sql=V.with_views(
    "SELECT row_id, premise, hypothesis, label, explanation_1, explanation_2, explanation_3, split FROM nli "
    "WHERE split IN ('validation', 'test')", "nli"))
def a1_read_splits(spark, sf):
    path = shared_path(spark, f"nli-{_tag(sf)}")
    io.cached(spark, path, lambda: _nli_for_io(spark, sf), schema=io.NLI_SCHEMA)
    return io.read_splits(spark, io.current(spark, path), ["validation", "test"])


@query("a3_a4_predictions_csv", ops=("A3", "A4", "B9"), sql=V.with_views(
    'SELECT input_text, generated_text, "references"[1] AS reference_texts_0, "references"[2] AS reference_texts_1, '
    '"references"[3] AS reference_texts_2 FROM gen_eval', "gen_eval"))
def a3_a4_predictions_csv(spark, sf):
    path = shared_path(spark, f"predictions-{_tag(sf)}")
    out = P.refs_to_columns(V.gen_eval(spark, sf).select("input_text", "generated_text", "references"))
    io.write_predictions(out, path)
    return io.read_predictions(spark, path + "/*.csv", with_file=False)


@query("a5_errors_csv", ops=("A5", "B4"), sql=V.with_views(
    "SELECT row_id, system, reference_label, predicted_label FROM label_preds "
    "WHERE NOT coalesce(reference_label = predicted_label, false)", "label_preds"))
def a5_errors_csv(spark, sf):
    from pyspark.sql import types as T
    path = shared_path(spark, f"errors-{_tag(sf)}")
    errs = L.errors(V.label_preds(spark, sf))
    io.write_errors(errs, path)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("system", T.StringType())]
                          + list(io.LABEL_PRED_SCHEMA.fields))
    return io.read_predictions(spark, path, schema=schema, with_file=False)


@query("a8_run_name", ops=("A8",), sql=V.with_views(
    "SELECT run, step, run || '_' || strftime(ts, '%m%d-%H:%M:%S') AS run_name FROM step_log", "step_log"))
def a8_run_name(spark, sf):
    return V.step_log(spark, sf).select("run", "step", io.run_name("run", "ts").alias("run_name"))
