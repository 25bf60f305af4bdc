"""Queries over vectors, logits, attributions and the bigram LM."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import attribution as A
from glossa.operators import labels as L
from glossa.operators import lm
from glossa.operators import probe
from glossa.operators import textmatch as TM
from glossa.operators import vectors as VEC
from glossa.plans import text_plans
from glossa.plans.registry import query, round_doubles
from glossa.sources import fixtures as V
from glossa.sources.tables import load


def _with(body: str, *views: str) -> str:
    return V.with_views("__BODY__", *views).replace("\n__BODY__", body)


_GM_PAIRS = """
, t AS (SELECT pair_id, side, pos, CAST(vec AS DOUBLE[]) AS v FROM tokvec WHERE mask = 1),
s AS (SELECT p.pair_id, p.pos AS ppos, r.pos AS rpos, list_cosine_similarity(p.v, r.v) AS cs
      FROM t p JOIN t r ON p.pair_id = r.pair_id AND p.side = 'pred' AND r.side = 'ref'),
pp AS (SELECT pair_id, avg(m) AS precision FROM (SELECT pair_id, ppos, max(cs) AS m FROM s GROUP BY ALL) GROUP BY ALL),
rr AS (SELECT pair_id, avg(m) AS recall FROM (SELECT pair_id, rpos, max(cs) AS m FROM s GROUP BY ALL) GROUP BY ALL),
prf AS (SELECT pair_id, precision, recall,
               CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
        FROM (SELECT a.pair_id, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall
              FROM (SELECT DISTINCT pair_id FROM tokvec) a LEFT JOIN pp USING (pair_id) LEFT JOIN rr USING (pair_id)))"""


@query("f7_greedy_match_pairs", ops=("F7",), sql=_with(_GM_PAIRS + """
SELECT pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf""",
                                                       "tokvec"))
def f7_greedy_match_pairs(spark, sf):
    return round_doubles(VEC.greedy_match_pairs(V.tokvec(spark, sf)))


_CODE = "instr('0123456789abcdef', substr(md5({w}), {i}, 1)) - 1"
_TEXT_MATCH_SQL = _with(f"""
, texts AS (SELECT row_number() OVER () AS tid, * FROM (
    SELECT system, row_id, -1 AS ref_idx, generated_text AS x FROM gen_eval
    UNION ALL SELECT system, row_id, unnest(range(0, len("references"))), unnest("references") FROM gen_eval)),
tok AS (SELECT tid, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i
        FROM (SELECT tid, {text_plans._ws('x')} AS w FROM texts)),
coded AS (SELECT tid, i, w, {_CODE.format(w='w', i=1)} AS spot,
                 CASE WHEN {_CODE.format(w='w', i=2)} < 8 THEN 1 ELSE -1 END AS sign FROM tok),
offs AS (SELECT unnest(range(-{TM.REACH}, {TM.REACH} + 1)) AS o),
places AS (SELECT tid, w, i + o AS j FROM tok CROSS JOIN offs),
near AS (SELECT a.w, b.spot, sum(b.sign) AS n FROM places a JOIN coded b ON a.tid = b.tid AND a.j = b.i GROUP BY ALL),
vecs AS (SELECT w, CAST([{', '.join(f'coalesce(sum(n) FILTER (WHERE spot = {k}), 0)' for k in range(TM.WIDTH))}]
                        AS DOUBLE[{TM.WIDTH}]) AS v FROM near GROUP BY w),
bag AS (SELECT tid, w, count(*) AS n FROM tok GROUP BY ALL),
vbag AS (SELECT tid, n, v, array_inner_product(v, v) AS q FROM bag JOIN vecs USING (w)),
pairs AS (SELECT p.system, p.tid AS pid, r.tid AS rid FROM texts p JOIN texts r
          ON p.system = r.system AND p.row_id = r.row_id AND p.ref_idx = -1 AND r.ref_idx >= 0),
pb AS (SELECT pid, rid, row_number() OVER () AS u, n, v, q FROM pairs JOIN vbag ON tid = pid),
rb AS (SELECT pid, rid, row_number() OVER () AS u, n, v, q FROM pairs JOIN vbag ON tid = rid),
s AS (SELECT p.pid, p.rid, p.u AS pu, r.u AS ru, p.n AS pn, r.n AS rn,
             CASE WHEN p.q * r.q > 0 THEN array_inner_product(p.v, r.v) / sqrt(p.q * r.q) ELSE 0 END AS c
      FROM pb p JOIN rb r ON p.pid = r.pid AND p.rid = r.rid),
pp AS (SELECT pid, rid, sum(n * m) / sum(n) AS precision
       FROM (SELECT pid, rid, pu, any_value(pn) AS n, max(c) AS m FROM s GROUP BY ALL) GROUP BY ALL),
rr AS (SELECT pid, rid, sum(n * m) / sum(n) AS recall
       FROM (SELECT pid, rid, ru, any_value(rn) AS n, max(c) AS m FROM s GROUP BY ALL) GROUP BY ALL),
prf AS (SELECT system, precision, recall, CASE WHEN precision + recall <> 0
                                          THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
        FROM (SELECT system, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall
              FROM pairs LEFT JOIN pp USING (pid, rid) LEFT JOIN rr USING (pid, rid)))
SELECT system, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1
FROM prf GROUP BY system""", "gen_eval")


@query("f7_text_match", ops=("F7", "E9"), sql=_TEXT_MATCH_SQL)
def f7_text_match(spark, sf):
    return round_doubles(TM.text_match(V.gen_eval(spark, sf), "generated_text", "references", ["system"]))


@query("e9_greedy_match_mean", ops=("F7", "E9"), sql=_with(_GM_PAIRS + """
SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM prf""",
                                                           "tokvec"))
def e9_greedy_match_mean(spark, sf):
    return round_doubles(VEC.greedy_match(V.tokvec(spark, sf)))


@query("j2_masked_mean_pool", ops=("J2",), sql=_with("""
, d AS (SELECT pair_id, side, mask, i, CAST(vec[i] AS DOUBLE) AS x
        FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM tokvec)),
g AS (SELECT pair_id, side, i, sum(mask * x) / count(*) AS m FROM d GROUP BY ALL)
SELECT pair_id, side, list(round(m, 6) ORDER BY i) AS pooled FROM g GROUP BY ALL""", "tokvec"))
def j2_masked_mean_pool(spark, sf):
    out = VEC.masked_mean_pool(V.tokvec(spark, sf))
    return out.select("pair_id", "side", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))


@query("j2_masked_mean_pool_by_mask", ops=("J2",), sql=_with("""
, d AS (SELECT pair_id, side, mask, i, CAST(vec[i] AS DOUBLE) AS x
        FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM tokvec)),
g AS (SELECT pair_id, side, i, sum(mask * x) / sum(mask) AS m FROM d GROUP BY ALL)
SELECT pair_id, side, list(round(m, 6) ORDER BY i) AS pooled FROM g GROUP BY ALL""", "tokvec"))
def j2_masked_mean_pool_by_mask(spark, sf):
    out = VEC.masked_mean_pool(V.tokvec(spark, sf), divide_by="mask")
    return out.select("pair_id", "side", F.transform("pooled", lambda x: F.round(x, 6)).alias("pooled"))


@query("j5_squeeze_sum", ops=("J5",), sql=V.with_views(
    "SELECT seq_id, src_pos, tgt_pos, round(sum(score), 6) AS score FROM attributions GROUP BY ALL", "attributions"))
def j5_squeeze_sum(spark, sf):
    return round_doubles(A.squeeze(V.attributions(spark, sf), "sum"))


@query("j5_squeeze_l2", ops=("J5",), sql=V.with_views(
    "SELECT seq_id, src_pos, tgt_pos, round(sqrt(sum(score * score)), 6) AS score FROM attributions GROUP BY ALL",
    "attributions"))
def j5_squeeze_l2(spark, sf):
    return round_doubles(A.squeeze(V.attributions(spark, sf), "l2"))


_SPAN_POS = "CASE WHEN tgt_pos >= 3 THEN tgt_pos - 1 WHEN tgt_pos > 1 THEN tgt_pos - (tgt_pos - 1) ELSE tgt_pos END"
_SQZ = ", sq AS (SELECT seq_id, src_pos, tgt_pos, sum(score) AS score FROM attributions GROUP BY ALL)"


def _span_sql(agg: str) -> str:
    return _with(_SQZ + f"""
, mp AS (SELECT seq_id, src_pos, {_SPAN_POS} AS tgt_pos, score FROM sq)
SELECT seq_id, src_pos, tgt_pos, round({agg}, 6) AS score FROM mp GROUP BY ALL""", "attributions")


@query("j6_span_absmax", ops=("J6",),
       sql=_span_sql("CASE WHEN max(score) >= -min(score) THEN max(score) ELSE min(score) END"))
def j6_span_absmax(spark, sf):
    return round_doubles(A.span_aggregate(A.squeeze(V.attributions(spark, sf)), [(1, 3)], "absmax"))


@query("j6_span_sum", ops=("J6",), sql=_span_sql("sum(score)"))
def j6_span_sum(spark, sf):
    return round_doubles(A.span_aggregate(A.squeeze(V.attributions(spark, sf)), [(1, 3)], "sum"))


@query("j6_span_mean", ops=("J6",), sql=_span_sql("avg(score)"))
def j6_span_mean(spark, sf):
    return round_doubles(A.span_aggregate(A.squeeze(V.attributions(spark, sf)), [(1, 3)], "mean"))


@query("j6_span_prod", ops=("J6",), sql=_span_sql("product(score)"))
def j6_span_prod(spark, sf):
    return round_doubles(A.span_aggregate(A.squeeze(V.attributions(spark, sf)), [(1, 3)], "prod"))


def _span_table_sql(agg: str) -> str:
    """Twin of the span table: a position goes on from the one before it if a span holds both, and moves down by the
    number of such positions up to it."""
    return _with(_SQZ + f"""
, on_from AS (SELECT DISTINCT seq_id, unnest(range(start + 1, "end")) AS q FROM spans WHERE "end" > start),
place AS (SELECT p.seq_id, p.tgt_pos, p.tgt_pos - count(q) AS position
          FROM (SELECT DISTINCT seq_id, tgt_pos FROM sq) p LEFT JOIN on_from o ON o.seq_id = p.seq_id AND o.q <= p.tgt_pos
          GROUP BY p.seq_id, p.tgt_pos)
SELECT sq.seq_id, src_pos, position AS tgt_pos, round({agg}, 6) AS score
FROM sq JOIN place USING (seq_id, tgt_pos) GROUP BY ALL""", "attributions", "spans")


@query("j6_span_table_absmax", ops=("J6",),
       sql=_span_table_sql("CASE WHEN max(score) >= -min(score) THEN max(score) ELSE min(score) END"))
def j6_span_table_absmax(spark, sf):
    """Each sequence has its own spans."""
    return round_doubles(A.span_aggregate(A.squeeze(V.attributions(spark, sf)), V.spans(spark, sf), "absmax"))


@query("j6_span_table_sum", ops=("J6",), sql=_span_table_sql("sum(score)"))
def j6_span_table_sum(spark, sf):
    return round_doubles(A.span_aggregate(A.squeeze(V.attributions(spark, sf)), V.spans(spark, sf), "sum"))


@query("j7_pair_diff", ops=("J7",), sql=_with(_SQZ + """
, full_seq AS (SELECT seq_id FROM sq GROUP BY seq_id HAVING count(DISTINCT tgt_pos) = 8),
pairs AS (SELECT a.seq_id FROM full_seq a JOIN full_seq b ON b.seq_id = a.seq_id + 1)
SELECT a.seq_id, a.src_pos, a.tgt_pos, round(a.score - b.score, 6) AS score
FROM sq a JOIN pairs USING (seq_id)
JOIN sq b ON b.seq_id = a.seq_id + 1 AND b.src_pos = a.src_pos AND b.tgt_pos = a.tgt_pos""", "attributions"))
def j7_pair_diff(spark, sf):
    return round_doubles(A.pair_diff(*A.next_pairs(A.squeeze(V.attributions(spark, sf)), 8)))


@query("j9_weight_by_step", ops=("J9",), sql=_with(_SQZ + """
SELECT seq_id, src_pos, tgt_pos, round(score * (1.0 / (1 + tgt_pos)), 6) AS score FROM sq""", "attributions"))
def j9_weight_by_step(spark, sf):
    sq = A.squeeze(V.attributions(spark, sf))
    steps = sq.select(A.TGT).distinct().withColumn("step_score", 1.0 / (1 + F.col(A.TGT)))
    return round_doubles(A.weight_by_step(sq, steps))


# ---- logits --------------------------------------------------------------------

_NLL = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) - logits[{y} + 1])"


@query("e6_cross_entropy", ops=("E6",), sql=V.with_views(
    f"SELECT round(avg({_NLL.format(y='y')}), 6) AS cross_entropy FROM logits", "logits"))
def e6_cross_entropy(spark, sf):
    return round_doubles(L.cross_entropy(V.logits(spark, sf)))


@query("e7_argmax", ops=("E7",), sql=V.with_views(
    "SELECT vec_id, y AS reference_label, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS "
    "predicted_label FROM logits", "logits"))
def e7_argmax(spark, sf):
    return V.logits(spark, sf).select("vec_id", F.col("y").alias("reference_label"),
                                      L.argmax("logits").alias("predicted_label"))


@query("f8_perplexity_logits", ops=("F8",), sql=V.with_views(
    f"SELECT round(exp(avg({_NLL.format(y='token_label')})), 6) AS perplexity FROM logits WHERE token_label <> -100",
    "logits"))
def f8_perplexity_logits(spark, sf):
    return round_doubles(lm.perplexity_from_logits(V.logits(spark, sf)))


# ---- bigram LM ---------------------------------------------------------------------

_TOKS = r"list_filter(regexp_split_to_array(trim({s}), '\s+'), lambda x: x <> '')"


def _lm_sql(**cols: str) -> str:
    """CTEs: the bigram model fitted on train, and ``lp_<name>`` log-probs per scored column."""
    out = f"""
, tr AS (SELECT ['<s>'] || {_TOKS.format(s='explanation_1')} AS t FROM nli WHERE split = 'train'),
bg AS (SELECT t[i] AS prev, t[i + 1] AS cur FROM (SELECT t, unnest(range(1, len(t))) AS i FROM tr)),
bc AS (SELECT prev, cur, count(*) AS c FROM bg GROUP BY ALL),
cc AS (SELECT prev, count(*) AS c FROM bg GROUP BY ALL),
v AS (SELECT count(DISTINCT cur) + 1 AS v FROM bg)"""
    for name, col in cols.items():
        out += f""",
te_{name} AS (SELECT row_id, ['<s>'] || {_TOKS.format(s=col)} AS t FROM nli WHERE split = 'test'),
tg_{name} AS (SELECT row_id, i AS step, t[i] AS prev, t[i + 1] AS cur
              FROM (SELECT row_id, t, unnest(range(1, len(t))) AS i FROM te_{name})),
lp_{name} AS (SELECT row_id, step, cur AS token,
                     ln((coalesce(bc.c, 0) + 1) / (coalesce(cc.c, 0) + v.v)) AS logprob
              FROM tg_{name} LEFT JOIN bc USING (prev, cur) LEFT JOIN cc USING (prev) CROSS JOIN v)"""
    return out


def _bigram_logprobs(spark, sf, col="explanation_1"):
    nli = V.nli(spark, sf)
    model = lm.fit_bigram(nli.filter(F.col("split") == "train"), "explanation_1")
    return lm.score_bigram(nli.filter(F.col("split") == "test"), col, model)


@query("f10_bigram_logprobs", ops=("F10",), sql=_with(_lm_sql(a="explanation_1") + """
SELECT row_id, step, token, round(logprob, 6) AS logprob FROM lp_a""", "nli"))
def f10_bigram_logprobs(spark, sf):
    return round_doubles(_bigram_logprobs(spark, sf))


@query("f8_perplexity_bigram", ops=("F8", "F10"), sql=_with(_lm_sql(a="explanation_1") + """
SELECT round(exp(-avg(logprob)), 6) AS perplexity FROM lp_a""", "nli"))
def f8_perplexity_bigram(spark, sf):
    return round_doubles(lm.perplexity(_bigram_logprobs(spark, sf)))


@query("j8_contrast_diff", ops=("J8",), sql=_with(_lm_sql(a="explanation_1", b="explanation_2") + """
SELECT row_id, step, round(exp(a.logprob) - exp(b.logprob), 6) AS prob_diff
FROM lp_a a JOIN lp_b b USING (row_id, step)""", "nli"))
def j8_contrast_diff(spark, sf):
    nli = V.nli(spark, sf)
    model = lm.fit_bigram(nli.filter(F.col("split") == "train"), "explanation_1")
    test = nli.filter(F.col("split") == "test")
    return round_doubles(A.contrast_diff(lm.score_bigram_pair(test, "explanation_1", "explanation_2", model)))


# ---- probe ---------------------------------------------------------------------

@query("j3_fit_probe_mlp", ops=("J3",))
def j3_fit_probe_mlp(spark, sf):
    """Train on vec_id % 5 <> 0, report accuracy / micro-F1 on the held-out fifth."""
    emb = load(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    train, test = emb.filter(F.col("vec_id") % 5 != 0), emb.filter(F.col("vec_id") % 5 == 0)
    model = probe.fit_probe(train, label="label", hidden=256, n_classes=10, kind="mlp", max_iter=50)
    return round_doubles(L.label_report(probe.score_probe(model, test)))


@query("j4_score_probe_logreg", ops=("J3", "J4"))
def j4_score_probe_logreg(spark, sf):
    emb = load(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    train, test = emb.filter(F.col("vec_id") % 5 != 0), emb.filter(F.col("vec_id") % 5 == 0)
    model = probe.fit_probe(train, label="label", kind="logreg", max_iter=50)
    return probe.score_probe(model, test)


# The twin solves the normal equations by Gauss-Jordan elimination, row by row, on lists (the ridge makes them definite).
_PROBE_SQL = """
WITH x AS (SELECT vec_id, label, list_append(list_transform(embedding, lambda c: CAST(c AS DOUBLE)), 1.0) AS x FROM embeddings),
tr AS (SELECT * FROM x WHERE vec_id % 5 <> 0),
cell AS (SELECT label, i, x[i] AS a, x FROM (SELECT label, x, unnest(range(1, len(x) + 1)) AS i FROM tr)),
gram AS (SELECT i, j, sum(a * x[j]) AS v FROM (SELECT i, a, x, unnest(range(1, len(x) + 1)) AS j FROM cell) GROUP BY i, j),
dim AS (SELECT max(i) AS d FROM gram),
classes AS (SELECT list(DISTINCT label ORDER BY label) AS cs FROM tr),
moment AS (SELECT i, label, sum(a) AS v FROM cell GROUP BY ALL),
lhs AS (SELECT i, list(v + CASE WHEN i = j AND i < d THEN 1.0 ELSE 0.0 END ORDER BY j) AS r FROM gram, dim GROUP BY i),
rhs AS (SELECT i, list(coalesce(v, 0.0) ORDER BY label) AS r
        FROM (SELECT i, unnest(cs) AS label FROM lhs, classes) LEFT JOIN moment USING (i, label) GROUP BY i),
m AS (SELECT list(list_concat(l.r, r.r) ORDER BY i) AS m FROM lhs l JOIN rhs r USING (i)),
done AS (SELECT list_reduce(range(1, len(m) + 1), lambda a, k: list_transform(a, lambda r, i:
           CASE WHEN i = k THEN list_transform(r, lambda c: c / a[k][k])
                ELSE list_transform(r, lambda c, j: c - r[k] * a[k][j] / a[k][k]) END), m) AS w FROM m),
te AS (SELECT vec_id, label, x, list_transform(range(1, len(cs) + 1), lambda c:
         list_sum(list_transform(x, lambda v, i: v * w[i][len(x) + c]))) AS s, cs
       FROM x, done, classes WHERE vec_id % 5 = 0),
scored AS (SELECT vec_id, CAST(label AS INTEGER) AS reference_label,
                  CAST(cs[list_position(s, list_max(s))] AS INTEGER) AS predicted_label FROM te)"""


def _linear_probe(spark, sf):
    """Fitted on vec_id % 5 <> 0, scored on the held-out fifth."""
    emb = load(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return probe.score_linear_probe(probe.fit_linear_probe(emb.filter(F.col("vec_id") % 5 != 0)),
                                    emb.filter(F.col("vec_id") % 5 == 0))


@query("j4_score_linear_probe", ops=("J3", "J4"), sql=_PROBE_SQL + """
SELECT vec_id, reference_label, predicted_label FROM scored""")
def j4_score_linear_probe(spark, sf):
    return _linear_probe(spark, sf)


@query("j3_linear_probe_report", ops=("J3", "E2"), sql=_PROBE_SQL + """,
n AS (SELECT reference_label, count(*) AS n FROM scored GROUP BY ALL)
SELECT round(avg(CAST(reference_label = predicted_label AS INTEGER)), 6) AS accuracy,
       round((SELECT max(n) FROM n) / count(*), 6) AS majority_accuracy FROM scored""")
def j3_linear_probe_report(spark, sf):
    """Held-out accuracy beside that of always naming the commonest class."""
    scored = _linear_probe(spark, sf)
    cells = scored.groupBy("reference_label").agg(
        F.count("*").alias("n"), F.sum((F.col("reference_label") == F.col("predicted_label")).cast("long")).alias("hits"))
    return round_doubles(cells.agg((F.sum("hits") / F.sum("n")).alias("accuracy"),
                                   (F.max("n") / F.sum("n")).alias("majority_accuracy")))
