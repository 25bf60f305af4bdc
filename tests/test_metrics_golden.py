"""Hand-computed goldens for the generation and label metrics."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators import labels as L
from glossa.operators import textmetrics as TM

SCHEMA = T.StructType([T.StructField("system", T.StringType()), T.StructField("generated_text", T.StringType()),
                       T.StructField("references", T.ArrayType(T.StringType()))])


def gen(spark, rows):
    return spark.createDataFrame([("S", p, r) for p, r in rows], SCHEMA)


def one(df, col):
    return df.collect()[0][col]


def test_identical_text_scores_one(spark):
    df = gen(spark, [("the cat sat on the mat", ["the cat sat on the mat"] * 3)])
    assert one(TM.bleu(df), "bleu") == pytest.approx(1.0)
    assert one(TM.chrf(df), "chrf") == pytest.approx(1.0)
    r = TM.rouge(df).collect()[0]
    for k in TM.ROUGE_KEYS:
        assert r[f"{k}_fmeasure"] == pytest.approx(1.0)


def test_disjoint_text_scores_zero(spark):
    df = gen(spark, [("alpha beta gamma", ["delta epsilon zeta"] * 3)])
    assert one(TM.bleu(df), "bleu") == 0.0
    r = TM.rouge(df).collect()[0]
    for k in TM.ROUGE_KEYS:
        assert r[f"{k}_fmeasure"] == 0.0


def test_bleu_clipping_and_brevity(spark):
    # pred "the the the the" vs ref "the cat": unigram clipped to 1 of 4 -> no bigram match -> 0
    assert one(TM.bleu(gen(spark, [("the the the the", ["the cat", "x", "y"])])), "bleu") == 0.0
    # exact prefix of a longer reference: precisions 1, brevity penalty exp(1 - 4/3)
    df = gen(spark, [("a b c", ["a b c d", "q", "r s t u v w"])])
    assert one(TM.bleu(df), "bleu") == pytest.approx(math.exp(1 - 4 / 3))


def test_bleu_length_tie_takes_first_reference(spark):
    # |pred| = 3, refs of length 2 and 4 are equally close: the first (2) is used, c > r -> BP = 1
    df = gen(spark, [("a b c", ["a b", "a b c d", "z"])])
    stats = TM._bleu_stats(df, "generated_text", "references", 3).collect()[0]
    assert stats["bleu_r"] == 2 and stats["bleu_c"] == 3


def test_empty_prediction_counts_zero_in_rouge_mean(spark):
    df = gen(spark, [("...", ["a b", "a b", "a b"]), ("a b", ["a b", "a b", "a b"])])
    r = TM.rouge(df, keys=("rouge1",)).collect()[0]
    assert r["rouge1_fmeasure"] == pytest.approx(0.5)


def test_rouge_l_le_rouge1_and_bounds(spark):
    df = gen(spark, [("a b c d e f", ["f e d c b a", "a c e", "b d f a"])])
    r = TM.rouge(df).collect()[0]
    assert r["rougeL_recall"] <= r["rouge1_recall"] + 1e-12
    for k in TM.ROUGE_KEYS:
        assert 0.0 <= r[f"{k}_fmeasure"] <= 1.0


def test_rouge_lsum_union_golden(spark):
    # reference "a b c d b" (one sentence); prediction sentences "b d." and "c b."
    # LCS positions (0-based in the reference): "b d" -> [1, 3], "c b" -> [2, 4]; union 4 hits
    df = gen(spark, [("b d. c b.", ["a b c d b", "a b c d b", "a b c d b"])])
    r = TM.rouge(df, keys=("rougeLsum",)).collect()[0]
    assert r["rougeLsum_recall"] == pytest.approx(4 / 5)
    assert r["rougeLsum_precision"] == pytest.approx(1.0)


LSCHEMA = T.StructType([T.StructField("reference_label", T.IntegerType()),
                        T.StructField("predicted_label", T.IntegerType())])


def test_weighted_prf_one_class_and_nulls(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (0, None)], LSCHEMA)
    acc = L.accuracy(df).collect()[0]["accuracy"]
    assert acc == pytest.approx(0.5)  # the null prediction is an error
    w = L.weighted_prf(df).collect()[0]
    assert w["recall"] == pytest.approx(acc)  # weighted recall = accuracy
    assert w["precision"] == pytest.approx(1.0)  # class 0: 2/2 predicted correct; class 1 has no support
    assert L.errors(df).count() == 2


def test_micro_f1_equals_accuracy(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (1, 1), (2, 0)], LSCHEMA)
    a = L.accuracy(df).collect()[0]["accuracy"]
    f = L.f1_micro(df).collect()[0]["f1_micro"]
    assert a == pytest.approx(f) == pytest.approx(3 / 5)


def test_argmax_first_max_and_cross_entropy(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([0.0, 0.0, 0.0], 2)], "logits array<double>, y int")
    got = [r[0] for r in df.select(L.argmax("logits")).collect()]
    assert got == [1, 0]
    ce = L.cross_entropy(df).collect()[0]["cross_entropy"]
    lse = math.log(math.exp(1) + 2 * math.exp(3))
    assert ce == pytest.approx(((lse - 3.0) + math.log(3)) / 2)
