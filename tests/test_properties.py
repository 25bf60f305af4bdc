"""Property tests: invariances and algebraic identities of the operators."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from glossa.operators import analysis as AN
from glossa.operators import textmetrics as TM
from glossa.operators import tokens as TK
from glossa.operators import vectors as VEC
from glossa.operators.rowindex import dense_index
from glossa.sources import fixtures as V


def test_metrics_independent_of_partitioning(spark):
    g = V.gen_eval(spark, SF_SMALL)
    a = {r["system"]: r["bleu"] for r in TM.bleu(g, by="system").collect()}
    b = {r["system"]: r["bleu"] for r in TM.bleu(g.repartition(7), by="system").collect()}
    assert a == pytest.approx(b)


def test_dense_index_is_dense_and_ordered(spark):
    g = V.gen_eval(spark, SF_SMALL).filter(F.col("system") == "A").select("row_id")
    idx = dense_index(g, ["row_id"], partitions=5).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in idx] == list(range(len(idx)))
    ids = [r["row_id"] for r in idx]
    assert ids == sorted(ids)


def test_error_overlap_cells_sum_to_rows(spark):
    lp = V.label_preds(spark, SF_SMALL)
    a = lp.filter(F.col("system") == "A").drop("system")
    b = lp.filter(F.col("system") == "B").drop("system")
    total = sum(r["n"] for r in AN.error_overlap(a, b).collect())
    assert total == a.count()


def test_decode_encode_roundtrip_in_vocab(spark):
    df = spark.createDataFrame([(1, "a b  c"), (2, ""), (3, "b z")], "row_id long, text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "token string, id int")
    enc = TK.encode(df, "text", vocab, 16, out="ids")
    got = {r["row_id"]: r["ids"] for r in enc.collect()}
    assert got == {1: [3, 4, 5, 1], 2: [1], 3: [4, 2, 1]}
    dec = {r["row_id"]: r["ids_text"] for r in TK.decode(enc, "ids", vocab).collect()}
    assert dec == {1: "a b c", 2: "", 3: "b"}


def test_truncate_pad_shift_edges(spark):
    df = spark.createDataFrame([([5, 6, 7, 1],), ([],)], "ids array<int>")
    r = df.select(TK.truncate("ids", 3).alias("t"), TK.pad_fixed("ids", 6).alias("p"),
                  TK.shift_right("ids").alias("s"), TK.attention_mask(TK.pad_fixed("ids", 6)).alias("m")).collect()
    assert r[0]["t"] == [5, 6, 1] and r[0]["p"] == [5, 6, 7, 1, 0, 0] and r[0]["s"] == [0, 5, 6, 7]
    assert r[0]["m"] == [1, 1, 1, 1, 0, 0]
    assert r[1]["t"] == [] and r[1]["s"] == [] and r[1]["p"] == [0] * 6


def test_pool_with_all_ones_mask_is_mean(spark):
    df = spark.createDataFrame([(1, "pred", [1.0, 2.0], 1), (1, "pred", [3.0, 6.0], 1)],
                               "pair_id long, side string, vec array<float>, mask int")
    r = VEC.masked_mean_pool(df).collect()[0]
    assert r["pooled"] == pytest.approx([2.0, 4.0])
    df0 = spark.createDataFrame([(1, "pred", [1.0, 2.0], 1), (1, "pred", [3.0, 6.0], 0)],
                                "pair_id long, side string, vec array<float>, mask int")
    assert VEC.masked_mean_pool(df0).collect()[0]["pooled"] == pytest.approx([0.5, 1.0])
    assert VEC.masked_mean_pool(df0, divide_by="mask").collect()[0]["pooled"] == pytest.approx([1.0, 2.0])


def test_greedy_match_blocking_does_not_change_scores(spark):
    tv = V.tokvec(spark, SF_SMALL)
    a = {r["pair_id"]: (r["precision"], r["recall"]) for r in VEC.greedy_match_pairs(tv, block=64).collect()}
    b = {r["pair_id"]: (r["precision"], r["recall"]) for r in VEC.greedy_match_pairs(tv, block=1).collect()}
    assert a.keys() == b.keys() and len(a) > 0
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_vocabulary_paths_agree(spark, monkeypatch):
    """Broadcast-table lookup (measured size fits) and explode+join+regroup (it does not) give the same ids and text."""
    from glossa.operators import batches as B
    from glossa.operators import tokens as TK
    from glossa.plans import prep_plans as PP
    nli = V.nli(spark, SF_SMALL)
    vocab = PP._vocab(spark, SF_SMALL)

    def run():
        ids = TK.encode(nli, "hypothesis", vocab, 64, out="ids")
        text = TK.decode(ids, "ids", vocab, out="text")
        prep = B.prepare(nli, vocab)
        return (sorted(map(tuple, ids.collect())), sorted(map(tuple, text.collect())),
                sorted((r.row_id, tuple(r.input_ids), tuple(r.labels)) for r in prep.collect()))

    assert TK.vocab_table(vocab) is not None
    fast = run()
    monkeypatch.setattr(TK, "BROADCAST_BUDGET", 0)
    assert TK.vocab_table(vocab) is None
    assert run() == fast


@pytest.mark.parametrize("view,width,fields", [
    ("gen_eval", 4, ["input_text", "references"]),
    ("nli", 5, ["premise", "hypothesis", "explanation_1", "explanation_2", "explanation_3"]),
])
def test_text_views_cover_every_line_whole(spark, view, width, fields):
    """Whole texts: per document, ceil(n / width) rows, and the rows' fields are exactly the
    document's non-blank lines (every line present, none cut, nothing else)."""
    from glossa.functions.text import lines
    from glossa.sources.tables import load

    docs = load(spark, SF_SMALL, "documents").select("doc_id", lines("text").alias("l")) \
        .filter(F.size("l") > 0) \
        .select("doc_id", F.size("l").alias("n"), F.array_sort(F.array_distinct("l")).alias("want"))
    rows = V.BUILDERS[view](spark, SF_SMALL)
    if "system" in rows.columns:
        rows = rows.filter(F.col("system") == "A")
    cols = [F.array(c) if c != "references" else F.col(c) for c in fields]
    got = rows.select(V.doc_of().alias("doc_id"), F.concat(*cols).alias("f")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("got"))
    j = docs.join(got, "doc_id", "full_outer")
    bad = j.filter(F.col("rows").isNull() | F.col("n").isNull()
                   | (F.col("rows") != F.expr(f"(n + {width - 1}) div {width}"))
                   | (F.col("got") != F.col("want")))
    assert docs.count() == load(spark, SF_SMALL, "documents").count()  # every document has text
    assert bad.count() == 0


def test_prevalence_preaggregated_equals_join_first(spark):
    """Reducing the texts per key before the join gives the join-first result."""
    text = V.gen_eval(spark, SF_SMALL).select(V.doc_of().alias("doc_id"), "system", "generated_text")
    labels = V.label_preds(spark, SF_SMALL).withColumnRenamed("row_id", "doc_id")
    pattern = r"(.+?) (the) (.+)"
    keyed = AN.prevalence_keyed(text, labels, ["doc_id", "system"], "generated_text", pattern, by="system")
    first = AN.prevalence(text.join(labels, ["doc_id", "system"]), "generated_text", pattern, by="system")
    assert sorted(map(tuple, keyed.collect())) == sorted(map(tuple, first.collect()))


def test_regex_literal_guard_is_exact(spark):
    """count_matches / match_group with the literal guard equal the bare regex everywhere."""
    from glossa.functions.text import count_matches, match_group
    pattern = r"(.+?) (the) (.+)"
    edge = spark.createDataFrame([(x,) for x in [
        " the start", "x the", "the the the", "a the b the c", "nothe here", None, "", " the ", "a\nthe b the c",
        "ü the ß"]], "generated_text string")
    texts = V.gen_eval(spark, SF_SMALL).select("generated_text").unionByName(edge)
    raw = F.regexp_count("generated_text", F.lit("(?d)" + pattern))
    got = texts.select(
        (count_matches("generated_text", pattern).eqNullSafe(raw)).alias("c"),
        *[(match_group("generated_text", i, pattern).eqNullSafe(
            F.regexp_extract("generated_text", "(?d)" + pattern, i))).alias(f"g{i}") for i in (1, 2, 3)])
    assert got.filter(~(F.col("c") & F.col("g1") & F.col("g2") & F.col("g3"))).count() == 0


def test_encode_keeps_rows_with_equal_keys_apart(spark, monkeypatch):
    from glossa.operators import tokens as TK
    df = spark.createDataFrame([(1, "a b"), (1, "b")], "row_id long, text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    want = [(1, [3, 4, 1]), (1, [4, 1])]
    for budget in (1 << 20, 0):
        monkeypatch.setattr(TK, "BROADCAST_BUDGET", budget)
        enc = TK.encode(df, "text", vocab, 16, out="ids")
        assert sorted((r.row_id, r.ids) for r in enc.collect()) == want
        assert sorted(r.ids_text for r in TK.decode(enc, "ids", vocab).collect()) == ["a b", "b"]


def test_greedy_match_scores_one_sided_and_zero_pairs_zero(spark):
    rows = [(1, "pred", 0, [1.0, 0.0], 1), (1, "ref", 0, [1.0, 0.0], 1), (2, "pred", 0, [1.0, 0.0], 1),
            (3, "pred", 0, [0.0, 0.0], 1), (3, "ref", 0, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "pair_id long, side string, pos long, vec array<float>, mask int")
    got = {r.pair_id: (r.precision, r.recall, r.f1) for r in VEC.greedy_match_pairs(df).collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_masked_pool_of_a_fully_masked_sequence(spark):
    df = spark.createDataFrame([(1, "pred", [1.0, 2.0], 0)], "pair_id long, side string, vec array<float>, mask int")
    assert VEC.masked_mean_pool(df).collect()[0]["pooled"] == [0.0, 0.0]
    assert VEC.masked_mean_pool(df, divide_by="mask").collect()[0]["pooled"] == [None, None]


def test_pair_diff_fails_on_misaligned_cells(spark):
    from glossa.operators import attribution as A
    schema = f"{A.SEQ} long, {A.SRC} long, {A.TGT} long, {A.SCORE} double"
    a = spark.createDataFrame([(0, 0, 0, 3.0), (1, 0, 0, 5.0)], schema)
    b = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 1.0)], schema)
    assert sorted(r[A.SCORE] for r in A.pair_diff(a, b).collect()) == [2.0, 4.0]
    with pytest.raises(Exception, match="not aligned"):
        A.pair_diff(a, b.filter(f"{A.SEQ} = 0")).collect()
