"""Canonical input views V1–V7 over the driver tables, each with a DuckDB SQL twin.

The Spark builders read the base tables with only the columns they need, so the
Parquet scan prunes columns; every derived column is a native expression. The SQL
twins (``SQL[name]``) are CTE bodies used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions.text import lines, tokens
from glossa.sources.tables import load

# Fixed values of the fixture definitions.
SYSTEMS = (("A", 7), ("B", 5))          # generated = reference 1 without every k-th token
LABEL_SYSTEMS = (("A", 10, 1), ("B", 7, 2))  # doc_id % m = 0 -> (ref + shift) % 3
TEST_EVERY, VAL_EVERY = 0, 1             # split = test if doc_id % 10 = 0, validation if = 1
STEPS_PER_EPOCH = 2500
CHUNK_STRIDE = 1 << 20                   # V1/V2 row_id = doc_id * 2^20 + chunk (a document has < 2^20 lines)


def _chunked(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> DataFrame:
    """Every non-blank line of every document, in chunks of ``len(fields)``
    consecutive lines: field j of chunk c is line ``(c·w + j) mod n`` (0-based,
    n lines), so the last chunk wraps to the start of its own document instead
    of leaving a field empty. Nothing is cut or dropped; a document without a
    non-blank line has no text and no chunk.

    The chunks are built in-row (one array of structs per document) and then
    exploded, so a row never carries its document's whole line array."""
    w = len(fields)
    docs = load(spark, sf_dir, "documents").select("doc_id", lines("text").alias("l"))
    l, n = F.col("l"), F.size("l")

    def chunk(c: Column) -> Column:
        return F.struct(c.alias("chunk"), *[F.element_at(l, (c * w + j) % n + 1).alias(f)
                                            for j, f in enumerate(fields)])

    last = F.expr(f"cast((size(l) + {w - 1}) div {w} - 1 AS INT)")
    return docs.filter(n > 0).select(
        "doc_id", F.explode(F.transform(F.sequence(F.lit(0), last), chunk)).alias("c")
    ).select((F.col("doc_id") * CHUNK_STRIDE + F.col("c.chunk")).alias("row_id"), "doc_id",
             *[F.col(f"c.{f}").alias(f) for f in fields])


def doc_of(row_id: str = "row_id") -> Column:
    """The document a V1 / V2 row comes from (the key of ``labels``)."""
    return F.expr(f"{row_id} div {CHUNK_STRIDE}")


def nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: chunks of 5 consecutive lines as NLI rows with 3 explanations."""
    rows = _chunked(spark, sf_dir, ("premise", "hypothesis", "explanation_1", "explanation_2", "explanation_3"))
    return rows.select(
        "row_id",
        F.when(F.col("doc_id") % 10 == TEST_EVERY, "test")
        .when(F.col("doc_id") % 10 == VAL_EVERY, "validation")
        .otherwise("train").alias("split"),
        "premise",
        "hypothesis",
        (F.col("row_id") % 3).cast("int").alias("label"),
        "explanation_1",
        "explanation_2",
        "explanation_3",
    )


def gen_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one row per (chunk of 4 lines, system): input, generated text, 3 references.

    Both systems come from one scan: the (system, k) pairs are exploded from a
    literal array rather than unioning two scans of ``documents``.
    """
    rows = _chunked(spark, sf_dir, ("input_text", "r1", "r2", "r3"))
    systems = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(k).alias("k")) for s, k in SYSTEMS])
    base = rows.select(
        "row_id",
        "input_text",
        tokens("r1").alias("t"),
        F.array("r1", "r2", "r3").alias("references"),
        F.explode(systems).alias("s"),
    )
    k = F.col("s.k")
    return base.select(
        "row_id",
        F.col("s.system").alias("system"),
        "input_text",
        F.array_join(F.filter("t", lambda x, i: i % k != k - 1), " ").alias("generated_text"),
        "references",
    )


def label_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: reference / predicted class per labelled document, for systems A and B."""
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    ref = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    systems = F.array(*[F.struct(F.lit(s).alias("system"), F.lit(m).alias("m"), F.lit(d).alias("d"))
                        for s, m, d in LABEL_SYSTEMS])
    base = lab.select(F.col("doc_id").alias("row_id"), ref.alias("ref"), F.explode(systems).alias("s"))
    return base.select(
        "row_id",
        F.col("s.system").alias("system"),
        F.col("ref").cast("int").alias("reference_label"),
        F.when(F.col("row_id") % F.col("s.m") == 0, (F.col("ref") + F.col("s.d")) % 3)
        .otherwise(F.col("ref")).cast("int").alias("predicted_label"),
    )


def label_preds_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3L: large unkeyed label table from lineitem (benchmark input for E1–E5)."""
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return li.select(
        F.col("l_returnflag").alias("reference_label"),
        F.when(F.col("l_partkey") % 10 == 0, F.lit("N")).otherwise(F.col("l_returnflag"))
        .alias("predicted_label"),
    )


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: training-step telemetry from events."""
    ev = load(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    return ev.select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("step"),
        F.expr(f"event_id div {STEPS_PER_EPOCH}").alias("epoch"),
        F.col("value").alias("loss"),
        (F.lit(1) + F.col("event_id") % 8).cast("bigint").alias("n"),
        "ts",
    )


def tokvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: token vectors of prediction / reference sides of a pair."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = F.col("vec_id")
    return emb.select(
        F.expr("vec_id div 8").alias("pair_id"),
        F.when(v % 8 < 4, "pred").otherwise("ref").alias("side"),
        (v % 4).cast("bigint").alias("pos"),
        F.col("embedding").alias("vec"),
        F.when(v % 8 == 7, 0).otherwise(1).alias("mask"),
        v.alias("vec_id"),
    )


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 in attribution form: (seq_id, src_pos, tgt_pos, hidden, score)."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = F.col("vec_id")
    return emb.select(
        F.expr("vec_id div 8").alias("seq_id"),
        (v % 8).cast("bigint").alias("tgt_pos"),
        F.posexplode("embedding").alias("dim", "score"),
    ).select(
        "seq_id",
        F.expr("cast(dim div 16 as bigint)").alias("src_pos"),
        "tgt_pos",
        (F.col("dim") % 16).cast("bigint").alias("hidden"),
        F.col("score").cast("double").alias("score"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans of target positions for each V5 sequence: some overlap, some only touch, some are empty or reversed,
    some reach past the end; every eleventh sequence has none."""
    seq = load(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("seq_id")).distinct() \
        .filter(F.col("seq_id") % 11 != 10)
    s = F.col("seq_id")
    both = F.array(F.struct((s % 5).alias("start"), (s % 5 + s % 4).alias("end")),
                   F.struct((s % 7).alias("start"), (s % 7 + s % 3 * 2 - s % 2).alias("end")))
    return seq.select("seq_id", F.inline(both))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: 3-class logits, class label and token label (-100 = ignored)."""
    emb = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    y = (F.col("label") % 3).cast("int")
    return emb.select(
        "vec_id",
        F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("logits"),
        y.alias("y"),
        F.when(F.col("vec_id") % 11 == 0, F.lit(-100)).otherwise(y).cast("int").alias("token_label"),
    )


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: user turn t followed by assistant turn t + 1 as (premise, hypothesis)."""
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("premise"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return u.join(a, ["conv_id", "turn"], "inner")


BUILDERS = {
    "nli": nli,
    "gen_eval": gen_eval,
    "label_preds": label_preds,
    "label_preds_lineitem": label_preds_lineitem,
    "step_log": step_log,
    "tokvec": tokvec,
    "attributions": attributions,
    "spans": spans,
    "logits": logits,
    "conv_pairs": conv_pairs,
}


# ---------------------------------------------------------------------------
# DuckDB twins (CTE bodies). ``lambda x: ...`` syntax; lists are 1-based.
# ---------------------------------------------------------------------------

_LINES = "list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)"
_TOK = "list_filter(regexp_split_to_array(trim({s}), '\\s+'), lambda x: x <> '')"


def _chunked_sql(*fields: str) -> str:
    """Twin of ``_chunked``: DuckDB lists are 1-based, ``range`` excludes its end."""
    w = len(fields)
    cols = ", ".join(f"l[(c * {w} + {j}) % len(l) + 1] AS {f}" for j, f in enumerate(fields))
    return f"""(SELECT doc_id * {CHUNK_STRIDE} + c AS row_id, doc_id, {cols}
  FROM (SELECT doc_id, l, unnest(range(0, (len(l) + {w - 1}) // {w})) AS c
        FROM (SELECT doc_id, {_LINES} AS l FROM documents) WHERE len(l) > 0))"""


SQL = {
    "nli": f"""
SELECT row_id,
       CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
       premise, hypothesis, CAST(row_id % 3 AS INTEGER) AS label, explanation_1, explanation_2, explanation_3
FROM {_chunked_sql('premise', 'hypothesis', 'explanation_1', 'explanation_2', 'explanation_3')}""",
    "gen_eval": f"""
SELECT row_id, s.system AS system, input_text,
       array_to_string(list_filter(t, lambda x, i: (i - 1) % s.k <> s.k - 1), ' ') AS generated_text,
       refs AS "references"
FROM (SELECT row_id, input_text, {_TOK.format(s='r1')} AS t, [r1, r2, r3] AS refs
      FROM {_chunked_sql('input_text', 'r1', 'r2', 'r3')})
CROSS JOIN (VALUES ('A', 7), ('B', 5)) AS s(system, k)""",
    "label_preds": """
SELECT row_id, s.system AS system, CAST(ref AS INTEGER) AS reference_label,
       CAST(CASE WHEN row_id % s.m = 0 THEN (ref + s.d) % 3 ELSE ref END AS INTEGER) AS predicted_label
FROM (SELECT doc_id AS row_id,
             CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 0 ELSE 1 END AS ref FROM labels)
CROSS JOIN (VALUES ('A', 10, 1), ('B', 7, 2)) AS s(system, m, d)""",
    "label_preds_lineitem": """
SELECT l_returnflag AS reference_label,
       CASE WHEN l_partkey % 10 = 0 THEN 'N' ELSE l_returnflag END AS predicted_label
FROM lineitem""",
    "step_log": f"""
SELECT event_type AS run, event_id AS step, CAST(event_id // {STEPS_PER_EPOCH} AS BIGINT) AS epoch,
       value AS loss, CAST(1 + event_id % 8 AS BIGINT) AS n, ts
FROM events""",
    "tokvec": """
SELECT vec_id // 8 AS pair_id, CASE WHEN vec_id % 8 < 4 THEN 'pred' ELSE 'ref' END AS side,
       vec_id % 4 AS pos, embedding AS vec, CASE WHEN vec_id % 8 = 7 THEN 0 ELSE 1 END AS mask, vec_id
FROM embeddings""",
    "attributions": """
SELECT vec_id // 8 AS seq_id, (i - 1) // 16 AS src_pos, vec_id % 8 AS tgt_pos, (i - 1) % 16 AS hidden,
       CAST(embedding[i] AS DOUBLE) AS score
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "spans": """
SELECT seq_id, unnest([seq_id % 5, seq_id % 7]) AS start,
       unnest([seq_id % 5 + seq_id % 4, seq_id % 7 + seq_id % 3 * 2 - seq_id % 2]) AS "end"
FROM (SELECT DISTINCT vec_id // 8 AS seq_id FROM embeddings) WHERE seq_id % 11 <> 10""",
    "logits": """
SELECT vec_id, list_transform(embedding[1:3], lambda x: CAST(x AS DOUBLE)) AS logits,
       CAST(label % 3 AS INTEGER) AS y,
       CAST(CASE WHEN vec_id % 11 = 0 THEN -100 ELSE label % 3 END AS INTEGER) AS token_label
FROM embeddings""",
    "conv_pairs": """
SELECT u.conv_id, u.turn, u.text AS premise, a.text AS hypothesis
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix an oracle query with the CTEs of the named views."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{body}"
