"""Generation-metric queries over V2 (two systems, 3 references per row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.text import rouge_tokens, tokens
from glossa.operators import textmetrics as T
from glossa.plans.registry import query, round_doubles
from glossa.sources import fixtures as V

# ---- shared SQL fragments -----------------------------------------------------

def _with(body: str, *views: str) -> str:
    """CTEs of the views followed by more CTEs: ``body`` starts with ``, name AS (...)``."""
    return V.with_views("__BODY__", *views).replace("\n__BODY__", body)



_WS = r"list_filter(regexp_split_to_array(trim({s}), '\s+'), lambda x: x <> '')"
_RG = r"list_filter(string_split(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_PUNCT_SQL = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def _ws(s: str) -> str:
    return _WS.format(s=s)


def _rg(s: str) -> str:
    return _RG.format(s=s)


_BLEU_SQL = _with(f"""
, toks AS (SELECT row_id, system, {_ws('generated_text')} AS p,
                  list_transform("references", lambda r: {_ws('r')}) AS rs FROM gen_eval),
ords AS (SELECT unnest([1, 2, 3]) AS n),
pgi AS (SELECT row_id, system, n, p, unnest(range(1, len(p) - n + 2)) AS i FROM toks CROSS JOIN ords),
pg AS (SELECT row_id, system, n, array_to_string(p[i:i + n - 1], ' ') AS g, count(*) AS c FROM pgi GROUP BY ALL),
rx AS (SELECT row_id, system, unnest(rs) AS r, unnest(range(1, len(rs) + 1)) AS ri FROM toks),
rgi AS (SELECT row_id, system, n, ri, r, unnest(range(1, len(r) - n + 2)) AS i FROM rx CROSS JOIN ords),
rg AS (SELECT row_id, system, n, ri, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS c FROM rgi GROUP BY ALL),
rmax AS (SELECT row_id, system, n, g, max(c) AS c FROM rg GROUP BY ALL),
clip AS (SELECT pg.system, pg.n, sum(least(pg.c, coalesce(rmax.c, 0))) AS num, sum(pg.c) AS den
         FROM pg LEFT JOIN rmax USING (row_id, system, n, g) GROUP BY ALL),
lens AS (SELECT system, sum(len(p)) AS c,
                sum(list_transform(rs, lambda r: len(r))[
                    list_position(list_transform(rs, lambda r: abs(len(r) - len(p))),
                                  list_min(list_transform(rs, lambda r: abs(len(r) - len(p)))))]) AS r
         FROM toks GROUP BY system),
k AS (SELECT system,
             coalesce(max(num) FILTER (WHERE n = 1), 0) AS n1, max(den) FILTER (WHERE n = 1) AS d1,
             coalesce(max(num) FILTER (WHERE n = 2), 0) AS n2, max(den) FILTER (WHERE n = 2) AS d2,
             coalesce(max(num) FILTER (WHERE n = 3), 0) AS n3, max(den) FILTER (WHERE n = 3) AS d3
      FROM clip GROUP BY system)
SELECT system, round(CASE WHEN least(n1, n2, n3) = 0 THEN 0.0 ELSE
         (CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END)
         * exp((ln(n1 / d1) + ln(n2 / d2) + ln(n3 / d3)) / 3) END, 6) AS bleu
FROM lens JOIN k USING (system)""", "gen_eval")


_PAIRS_CTE = f"""
, pr AS (SELECT row_id, system, generated_text, unnest("references") AS ref,
                unnest(range(0, len("references"))) AS ri FROM gen_eval),
rt AS (SELECT row_id, system, ri, {_rg('generated_text')} AS p, {_rg('ref')} AS r FROM pr)"""

_ROUGE_N_SQL = _with(_PAIRS_CTE + """,
ords AS (SELECT unnest([1, 2]) AS n),
pgi AS (SELECT row_id, system, ri, n, p, unnest(range(1, len(p) - n + 2)) AS i FROM rt CROSS JOIN ords),
pg AS (SELECT row_id, system, ri, n, array_to_string(p[i:i + n - 1], ' ') AS g, count(*) AS c FROM pgi GROUP BY ALL),
rgi AS (SELECT row_id, system, ri, n, r, unnest(range(1, len(r) - n + 2)) AS i FROM rt CROSS JOIN ords),
rg AS (SELECT row_id, system, ri, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS c FROM rgi GROUP BY ALL),
hits AS (SELECT row_id, system, ri, n, sum(least(pg.c, rg.c)) AS h FROM pg JOIN rg USING (row_id, system, ri, n, g)
         GROUP BY ALL),
pairs AS (SELECT rt.system, o.n, greatest(len(rt.p) - o.n + 1, 0) AS pl, greatest(len(rt.r) - o.n + 1, 0) AS rl,
                 coalesce(h.h, 0) AS h
          FROM rt CROSS JOIN ords o
          LEFT JOIN hits h ON h.row_id = rt.row_id AND h.system = rt.system AND h.ri = rt.ri AND h.n = o.n),
prf AS (SELECT system, n, CASE WHEN pl = 0 OR rl = 0 THEN 0.0 ELSE h / pl END AS p,
                          CASE WHEN pl = 0 OR rl = 0 THEN 0.0 ELSE h / rl END AS r FROM pairs),
prf2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM prf)
SELECT system,
  round(avg(f) FILTER (WHERE n = 1), 6) AS rouge1_fmeasure, round(avg(p) FILTER (WHERE n = 1), 6) AS rouge1_precision,
  round(avg(r) FILTER (WHERE n = 1), 6) AS rouge1_recall,
  round(avg(f) FILTER (WHERE n = 2), 6) AS rouge2_fmeasure, round(avg(p) FILTER (WHERE n = 2), 6) AS rouge2_precision,
  round(avg(r) FILTER (WHERE n = 2), 6) AS rouge2_recall
FROM prf2 GROUP BY system""", "gen_eval")


_WORD_BITS = 60  # of a target row's bit words in the LCS twins

_FULL_WORDS = (f"list_transform(range(0, (n + {_WORD_BITS - 1}) // {_WORD_BITS}), lambda w: "
               f"(1::BIGINT << CAST(least({_WORD_BITS}, n - w * {_WORD_BITS}) AS INTEGER)) - 1)")


def _lcs_step(v: str, full: str) -> str:
    """One row of the LCS table after the one in ``v(w)``: bit j of the row is 0 where the LCS grows at target
    position j; ``ms`` holds the positions of the predicted token. The words are added with carry."""
    u = f"({v} & ms[w])"
    s = f"({v} + {u} + a.c)"
    return (f"list_reduce(range(1, len(ms) + 1), lambda a, w: {{'c': {s} >> {_WORD_BITS}, "
            f"'o': list_append(a.o, ({s} | ({v} - {u})) & {full}[w])}}, {{'c': 0::BIGINT, 'o': []::BIGINT[]}}).o")


def _prf_sql(name: str, table: str) -> str:
    """Mean precision, recall and F of ``table`` (system, pl, rl, h)."""
    return f"""
SELECT system, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 6) AS {name}_fmeasure,
       round(avg(p), 6) AS {name}_precision, round(avg(r), 6) AS {name}_recall
FROM (SELECT system, CASE WHEN pl = 0 OR rl = 0 THEN 0.0 ELSE h / pl END AS p,
             CASE WHEN pl = 0 OR rl = 0 THEN 0.0 ELSE h / rl END AS r FROM {table}) GROUP BY system"""


# ROUGE-L: the predicted tokens that occur in the reference, in order, each move the bit row of the LCS table on.
_ROUGE_L_SQL = _with(_PAIRS_CTE + f""",
lp AS MATERIALIZED (SELECT row_number() OVER () AS id, *, len(r) AS n FROM rt),
tok AS (SELECT id, n, unnest(r) AS t, unnest(range(len(r))) AS j FROM lp),
words AS (SELECT id, t, j // {_WORD_BITS} AS w,
                 CAST(sum(1::HUGEINT << CAST(j % {_WORD_BITS} AS INTEGER)) AS BIGINT) AS b FROM tok GROUP BY ALL),
slots AS (SELECT id, t, unnest(range((n + {_WORD_BITS - 1}) // {_WORD_BITS})) AS w FROM (SELECT DISTINCT id, n, t FROM tok)),
masks AS (SELECT id, t, list(coalesce(b, 0) ORDER BY w) AS ms FROM slots LEFT JOIN words USING (id, t, w) GROUP BY id, t),
steps AS (SELECT l.id, list(ms ORDER BY i) AS steps
          FROM (SELECT id, unnest(p) AS t, unnest(range(len(p))) AS i FROM lp) l JOIN masks USING (id, t) GROUP BY l.id),
lcs AS (SELECT system, len(p) AS pl, n AS rl, CASE WHEN steps IS NULL THEN 0 ELSE n - list_sum(list_transform(
          list_reduce(steps, lambda v, ms: {_lcs_step('v[w]', 'fw')}, fw), lambda x: bit_count(x))) END AS h
        FROM (SELECT *, {_FULL_WORDS} AS fw FROM lp) LEFT JOIN steps USING (id))"""
                     + _prf_sql("rougeL", "lcs"), "gen_eval")


def _sentences_sql(s: str) -> str:
    return (f"list_filter(string_split(regexp_replace(trim({s}), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
            "lambda x: x <> '')")


def _last_bit(word: str, state: str) -> str:
    """The last position (1-based, 0 for none) up to ``state``.j whose bit is set in ``word``, a function of w."""
    below = (f"(({word}) & (CASE WHEN {state}.j >= (w + 1) * {_WORD_BITS} THEN {(1 << _WORD_BITS) - 1} "
             f"ELSE (1::BIGINT << CAST({state}.j - w * {_WORD_BITS} AS INTEGER)) - 1 END))")
    return (f"coalesce(list_max(list_transform(range(0, ({state}.j + {_WORD_BITS - 1}) // {_WORD_BITS}), lambda w: "
            f"CASE WHEN {below} = 0 THEN 0 ELSE w * {_WORD_BITS} + length(bin({below})) END)), 0)")


_GROWTH = "fw[w + 1] - v[s * nw + w + 1]"  # where the LCS grows in the row after step s

# ROUGE-Lsum: the LCS tables of all sentence pairs that share a token are kept row by row and traced back from their
# ends: on a row, the path goes left to the last match, unless the LCS grows after it; there it goes up. Rows of
# predicted tokens that the reference lacks equal the row below and only let the path go left.
_ROUGE_LSUM_SQL = _with(_PAIRS_CTE.partition(",\nrt AS")[0] + f""",
px AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM pr),
ps AS (SELECT pid, {_rg('s')} AS p, si FROM (SELECT pid, unnest(l) AS s, unnest(range(len(l))) AS si
       FROM (SELECT pid, {_sentences_sql('generated_text')} AS l FROM px))),
rs AS (SELECT pid, {_rg('s')} AS r, ti FROM (SELECT pid, unnest(l) AS s, unnest(range(len(l))) AS ti
       FROM (SELECT pid, {_sentences_sql('ref')} AS l FROM px))),
ptok AS (SELECT pid, si, unnest(p) AS t, unnest(range(len(p))) AS i, len(p) AS m FROM ps),
rtok AS (SELECT pid, ti, unnest(r) AS t, unnest(range(len(r))) AS j, len(r) AS n FROM rs),
words AS (SELECT pid, ti, t, j // {_WORD_BITS} AS w,
                 CAST(sum(1::HUGEINT << CAST(j % {_WORD_BITS} AS INTEGER)) AS BIGINT) AS b FROM rtok GROUP BY ALL),
slots AS (SELECT pid, ti, t, n, unnest(range((n + {_WORD_BITS - 1}) // {_WORD_BITS})) AS w
          FROM (SELECT DISTINCT pid, ti, t, n FROM rtok)),
masks AS (SELECT pid, ti, t, n, list(coalesce(b, 0) ORDER BY w) AS ms
          FROM slots LEFT JOIN words USING (pid, ti, t, w) GROUP BY ALL),
met AS (SELECT pid, si, ti, n, i, ms, coalesce(lead(i) OVER (PARTITION BY pid, si, ti ORDER BY i), m) > i + 1 AS gap
        FROM ptok JOIN masks USING (pid, t)),
steps AS MATERIALIZED (SELECT pid, si, ti, n, list(ms ORDER BY i) AS steps, list(gap ORDER BY i) AS gaps
                       FROM met GROUP BY pid, si, ti, n),
tables AS MATERIALIZED (SELECT *, (n + {_WORD_BITS - 1}) // {_WORD_BITS} AS nw, {_FULL_WORDS} AS fw FROM steps),
filled AS MATERIALIZED (SELECT *, list_reduce(steps, lambda v, ms:
  list_concat(v, {_lcs_step('v[len(v) - nw + w]', 'fw')}), fw) AS v FROM tables),
traced AS (SELECT pid, ti, list_reduce(list_reverse(range(1, len(steps) + 1)), lambda b, s:
  list_transform([{{'j': CASE WHEN gaps[s] THEN {_last_bit(_GROWTH, 'b')} ELSE b.j END, 'o': b.o}}], lambda a:
    list_transform([{{'hit': {_last_bit('steps[s][w + 1]', 'a')}, 'up': {_last_bit(_GROWTH, 'a')}}}], lambda x:
      {{'j': CASE WHEN x.hit > 0 AND x.hit >= x.up THEN x.hit - 1 ELSE x.up END,
        'o': CASE WHEN x.hit > 0 AND x.hit >= x.up THEN list_append(a.o, x.hit - 1) ELSE a.o END}})[1])[1],
  {{'j': n, 'o': []::BIGINT[]}}).o AS pos FROM filled),
hit AS (SELECT DISTINCT pid, ti, unnest(pos) AS j FROM traced),
found AS (SELECT pid, t, count(*) AS c FROM hit JOIN rtok USING (pid, ti, j) GROUP BY ALL),
pcount AS (SELECT pid, t, count(*) AS c FROM ptok GROUP BY ALL),
hits AS (SELECT pid, sum(least(f.c, p.c)) AS h FROM found f JOIN pcount p USING (pid, t) GROUP BY pid),
lsum AS (SELECT system, coalesce(pl, 0) AS pl, coalesce(rl, 0) AS rl, coalesce(h, 0) AS h FROM px LEFT JOIN hits USING (pid)
         LEFT JOIN (SELECT pid, count(*) AS pl FROM ptok GROUP BY pid) USING (pid)
         LEFT JOIN (SELECT pid, count(*) AS rl FROM rtok GROUP BY pid) USING (pid))"""
                        + _prf_sql("rougeLsum", "lsum"), "gen_eval")


_CHRF_SQL = _with(f"""
, cw AS (SELECT row_id, system, 0 AS k, generated_text AS s FROM gen_eval
         UNION ALL
         SELECT row_id, system, ri AS k, r AS s
         FROM (SELECT row_id, system, unnest("references") AS r, unnest(range(1, len("references") + 1)) AS ri
               FROM gen_eval)),
cc AS (SELECT row_id, system, k, replace(trim(s), ' ', '') AS cs,
              flatten(list_transform({_ws('s')}, lambda w:
                CASE WHEN length(w) = 1 THEN [w]
                     WHEN contains({_PUNCT_SQL}, right(w, 1)) THEN [left(w, length(w) - 1), right(w, 1)]
                     WHEN contains({_PUNCT_SQL}, left(w, 1)) THEN [left(w, 1), substr(w, 2)]
                     ELSE [w] END)) AS ws
       FROM cw),
ords AS (SELECT unnest(range(1, 9)) AS o),
gi AS (SELECT row_id, system, k, o,
              CASE WHEN o <= 6 THEN substr(cs, i, o) ELSE array_to_string(ws[i:i + o - 7], ' ') END AS g
       FROM (SELECT row_id, system, k, o, cs, ws,
                    unnest(range(1, CASE WHEN o <= 6 THEN length(cs) - o + 2 ELSE len(ws) - (o - 6) + 2 END)) AS i
             FROM cc CROSS JOIN ords)),
gc AS (SELECT row_id, system, k, o, g, count(*) AS c FROM gi GROUP BY ALL),
tot AS (SELECT row_id, system, k, o, sum(c) AS t FROM gc GROUP BY ALL),
mt AS (SELECT r.row_id, r.system, r.k, r.o, sum(least(p.c, r.c)) AS m
       FROM gc r JOIN gc p ON p.row_id = r.row_id AND p.system = r.system AND p.k = 0 AND p.o = r.o AND p.g = r.g
       WHERE r.k > 0 GROUP BY ALL),
grid AS (SELECT row_id, system, k, o FROM (SELECT row_id, system, k FROM cw WHERE k > 0) CROSS JOIN ords),
st AS (SELECT g.row_id, g.system, g.k, g.o, coalesce(mt.m, 0) AS m, coalesce(hp.t, 0) AS h, coalesce(tr.t, 0) AS r
       FROM grid g
       LEFT JOIN mt USING (row_id, system, k, o)
       LEFT JOIN tot tr USING (row_id, system, k, o)
       LEFT JOIN (SELECT row_id, system, o, t FROM tot WHERE k = 0) hp USING (row_id, system, o)),
fo AS (SELECT *, CASE WHEN h > 0 THEN m / h ELSE 0.0 END AS pp, CASE WHEN r > 0 THEN m / r ELSE 0.0 END AS rr FROM st),
fo2 AS (SELECT *, CASE WHEN 4 * pp + rr > 0 THEN 5 * pp * rr / (4 * pp + rr) ELSE 0.0 END AS f FROM fo),
sf AS (SELECT row_id, system, k,
              (sum(f) FILTER (WHERE o = 1) + sum(f) FILTER (WHERE o = 2) + sum(f) FILTER (WHERE o = 3)
               + sum(f) FILTER (WHERE o = 4) + sum(f) FILTER (WHERE o = 5) + sum(f) FILTER (WHERE o = 6)
               + sum(f) FILTER (WHERE o = 7) + sum(f) FILTER (WHERE o = 8)) / 8 AS fs
       FROM fo2 GROUP BY ALL),
best AS (SELECT row_id, system, k FROM (
           SELECT *, row_number() OVER (PARTITION BY row_id, system ORDER BY fs DESC, k) AS rn FROM sf)
         WHERE rn = 1 AND fs > 0),
corp AS (SELECT s.system, o.o,
                coalesce((SELECT sum(st.m) FROM st JOIN best b USING (row_id, system, k)
                          WHERE st.system = s.system AND st.o = o.o), 0) AS m,
                coalesce((SELECT sum(t) FROM tot WHERE tot.k = 0 AND tot.system = s.system AND tot.o = o.o), 0) AS h,
                coalesce((SELECT sum(st.r) FROM st JOIN best b USING (row_id, system, k)
                          WHERE st.system = s.system AND st.o = o.o), 0) AS r
         FROM (SELECT DISTINCT system FROM gen_eval) s CROSS JOIN ords o),
cf AS (SELECT *, CASE WHEN h > 0 THEN m / h ELSE 0.0 END AS pp, CASE WHEN r > 0 THEN m / r ELSE 0.0 END AS rr FROM corp),
cf2 AS (SELECT *, CASE WHEN 4 * pp + rr > 0 THEN 5 * pp * rr / (4 * pp + rr) ELSE 0.0 END AS f FROM cf)
SELECT system, round((sum(f) FILTER (WHERE o = 1) + sum(f) FILTER (WHERE o = 2) + sum(f) FILTER (WHERE o = 3)
               + sum(f) FILTER (WHERE o = 4) + sum(f) FILTER (WHERE o = 5) + sum(f) FILTER (WHERE o = 6)
               + sum(f) FILTER (WHERE o = 7) + sum(f) FILTER (WHERE o = 8)) / 8, 6) AS chrf
FROM cf2 GROUP BY system""", "gen_eval")


# ---- queries -----------------------------------------------------------------

@query("f1_ngrams_word2", ops=("F1",), sql=_with(f"""
, toks AS (SELECT row_id, system, {_ws('generated_text')} AS p FROM gen_eval),
gi AS (SELECT row_id, system, p, unnest(range(1, len(p))) AS i FROM toks)
SELECT row_id, system, array_to_string(p[i:i + 1], ' ') AS gram, count(*) AS count FROM gi GROUP BY ALL""",
                                                           "gen_eval"))
def f1_ngrams_word2(spark, sf):
    return T.ngrams(V.gen_eval(spark, sf), "generated_text", 2, "word", keys=("row_id", "system"))


@query("f1_ngrams_char3", ops=("F1",), sql=_with("""
, cs AS (SELECT row_id, system, replace(trim(generated_text), ' ', '') AS s FROM gen_eval),
gi AS (SELECT row_id, system, s, unnest(range(1, length(s) - 1)) AS i FROM cs)
SELECT row_id, system, substr(s, i, 3) AS gram, count(*) AS count FROM gi GROUP BY ALL""", "gen_eval"))
def f1_ngrams_char3(spark, sf):
    return T.ngrams(V.gen_eval(spark, sf), "generated_text", 3, "char", keys=("row_id", "system"))


@query("f9_expand_refs", ops=("F9", "B9"), sql=V.with_views("""SELECT row_id, system, generated_text,
    unnest(range(0, len("references"))) AS ref_idx, unnest("references") AS reference FROM gen_eval""", "gen_eval"))
def f9_expand_refs(spark, sf):
    return T.expand_refs(V.gen_eval(spark, sf).select("row_id", "system", "generated_text", "references"))


@query("f2_bleu", ops=("F2",), sql=_BLEU_SQL)
def f2_bleu(spark, sf):
    return round_doubles(T.bleu(V.gen_eval(spark, sf), by="system"))


@query("f3_chrf", ops=("F3",), sql=_CHRF_SQL)
def f3_chrf(spark, sf):
    return round_doubles(T.chrf(V.gen_eval(spark, sf), by="system"))


@query("f4_rouge_n", ops=("F4", "G4"), sql=_ROUGE_N_SQL)
def f4_rouge_n(spark, sf):
    return round_doubles(T.rouge(V.gen_eval(spark, sf), keys=("rouge1", "rouge2"), by="system"))


@query("f5_rouge_l", ops=("F5",), sql=_ROUGE_L_SQL)
def f5_rouge_l(spark, sf):
    return round_doubles(T.rouge(V.gen_eval(spark, sf), keys=("rougeL",), by="system"))


@query("g4_tokens", ops=("G4",), sql=V.with_views(f"""SELECT row_id, system,
    len({_ws('generated_text')}) AS n_ws_tokens, len({_rg('generated_text')}) AS n_rouge_tokens,
    array_to_string({_rg('generated_text')}, ' ') AS rouge_text FROM gen_eval""", "gen_eval"))
def g4_tokens(spark, sf):
    return V.gen_eval(spark, sf).select(
        "row_id", "system", F.size(tokens("generated_text")).alias("n_ws_tokens"),
        F.size(rouge_tokens("generated_text")).alias("n_rouge_tokens"),
        F.array_join(rouge_tokens("generated_text"), " ").alias("rouge_text"))


@query("f6_rouge_lsum", ops=("F6", "G3"), sql=_ROUGE_LSUM_SQL)
def f6_rouge_lsum(spark, sf):
    return round_doubles(T.rouge(V.gen_eval(spark, sf), keys=("rougeLsum",), by="system"))
