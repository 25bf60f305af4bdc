"""Random-indexing vectors and the per-system text match against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import textmatch as TM

SCHEMA = "row_id long, system string, p string, refs array<string>"
ROWS = [
    (1, "A", "the cat sat on the mat", ["a cat sat on a mat", "the cat is here", ""]),
    (1, "B", "a dog lay", ["a cat sat on a mat", "the cat is here", ""]),
    (2, "A", None, ["some text", "  ", None]),
    (2, "A", "the " * 400 + "end", ["the end", "the " * 300, "nothing shared"]),
    (2, "A", "the " * 400 + "end", ["the end", "the " * 300, "nothing shared"]),  # a repeated row stays apart
    (3, "B", "", ["", "x", "the"]),
    (4, "B", "lone", []),
    (5, "B", "lone", None),
]


def _vectors(texts):
    out = defaultdict(lambda: np.zeros(TM.WIDTH))
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(max(0, i - TM.REACH), min(len(w), i + TM.REACH + 1)):
                h = hashlib.md5(w[j].encode()).hexdigest()
                out[w[i]][int(h[0], 16)] += 1 if int(h[1], 16) < 8 else -1
    return out


def _score(vec, a, b):
    a, b = (a or "").split(), (b or "").split()
    if not a or not b:
        return 0.0, 0.0

    def cos(x, y):
        n = np.linalg.norm(vec[x]) * np.linalg.norm(vec[y])
        return vec[x] @ vec[y] / n if n else 0.0
    return (np.mean([max(cos(x, y) for y in set(b)) for x in a]), np.mean([max(cos(x, y) for x in set(a)) for y in b]))


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("token", F.lit("x")).withColumn("vec", F.lit(1))


def test_token_vectors_equal_brute_force(spark, df):
    texts = [t for r in ROWS for t in [r[2], *(r[3] or [])]]
    got = {r.token: r.vec for r in TM.token_vectors(spark.createDataFrame([(t,) for t in texts], "x string"), "x").collect()}
    want = _vectors(texts)
    assert set(got) == set(want)
    for t, v in got.items():
        assert v == list(want[t])


@pytest.mark.parametrize("chunk_rows, block", [(256, 512), (1, 2)])
def test_pairs_equal_brute_force(spark, df, monkeypatch, chunk_rows, block):
    monkeypatch.setattr(TM, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(TM, "BLOCK", block)
    texts = [t for r in ROWS for t in [r[2], *(r[3] or [])]]
    vec = _vectors(texts)
    vectors = TM.token_vectors(spark.createDataFrame([(t,) for t in texts], "x string"), "x")
    got = Counter((r.row_id, r.system, r.ref_idx, round(r.precision, 9), round(r.recall, 9))
                  for r in TM.text_match_pairs(df, vectors, "p", "refs", ["row_id", "system"]).collect())
    want = Counter((i, s, k, *(round(x, 9) for x in _score(vec, p, ref)))
                   for i, s, p, refs in ROWS for k, ref in enumerate(refs or []))
    assert got == want


def test_systems_differ_and_tables_may_be_empty(spark, df):
    got = {r.system: r for r in TM.text_match(df, "p", "refs", ["system"]).collect()}
    assert set(got) == {"A", "B"} and got["A"].f1 != got["B"].f1
    assert all(0 <= r.f1 <= 1 for r in got.values())
    assert TM.text_match(df.limit(0), "p", "refs", ["system"]).count() == 0


def test_unknown_tokens_are_zero_vectors(spark, df):
    none = TM.token_vectors(spark.createDataFrame([], "x string"), "x")
    rows = TM.text_match_pairs(df, none, "p", "refs", ["row_id"]).collect()
    assert rows and all(r.precision == r.recall == r.f1 == 0 for r in rows)


def test_index_codes_are_computed_once_a_text(spark, df):
    """The codes are projected before the windows slice them; inlined they would cost a pass over the text per word."""
    plan = TM.token_vectors(df, "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 2
    line = next(x for x in plan.splitlines() if "slice(" in x)
    assert "md5" not in line


@pytest.mark.parametrize("slice_chars", [1 << 22, 10])
def test_vectors_of_arrays_equal_those_of_texts(spark, df, monkeypatch, slice_chars):
    monkeypatch.setattr(TM, "SLICE_CHARS", slice_chars)
    lists = spark.createDataFrame([([p, *(refs or [])],) for _, _, p, refs in ROWS] + [(None,), ([],)], "x array<string>")
    one = {r.token: r.vec for r in TM.token_vectors(lists.select(F.explode("x").alias("x")), "x").collect()}
    assert one and {r.token: r.vec for r in TM.token_vectors(lists, "x").collect()} == one


def test_text_match_is_never_gathered_on_the_driver(spark, df):
    """The vectors of an unbounded vocabulary were broadcast whenever their estimate was small, and every token of
    every text was exploded with its neighbours."""
    match = TM.text_match(df, "p", "refs", ["system"])
    match.collect()
    plan = match._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "explode" not in plan


def test_texts_are_read_once_for_tokens_and_vectors(spark, df):
    """The tokens of a chunk and their sums took a pass each, a shuffle each and a join."""
    plan = TM.text_match(df, "p", "refs", ["system"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize("chunk_rows, slice_chars, cells, block", [(4, 1 << 22, 1 << 17, 512), (1, 10, 1, 2), (1 << 14, 30, 40, 3)])
def test_groups_equal_brute_force(spark, df, monkeypatch, chunk_rows, slice_chars, cells, block):
    """However rows fall into chunks, slices and pairs matched together; f1 of a negative sum keeps its sign."""
    for name, value in (("CHUNK_ROWS", chunk_rows), ("SLICE_CHARS", slice_chars), ("CELLS", cells), ("BLOCK", block)):
        monkeypatch.setattr(TM, name, value)
    vec = _vectors([t for r in ROWS for t in [r[2], *(r[3] or [])]])
    for r in TM.text_match(df, "p", "refs", ["system"]).collect():
        pairs = np.array([_score(vec, p, ref) for _, s, p, refs in ROWS if s == r.system for ref in refs or []])
        f1 = [2 * p * q / (p + q) if p + q else 0.0 for p, q in pairs]
        assert np.allclose([r.precision, r.recall, r.f1], [*pairs.mean(axis=0), np.mean(f1)], atol=1e-9)


def test_negative_cosines_keep_their_f1():
    names, unit = TM.pa.array(["a", "b"]), np.array([[1.0] + [0.0] * 15, [-0.6, 0.8] + [0.0] * 14, [0.0] * 16])
    p, q = TM.Bags(["a", "b", "a c"], names, unit).match(np.array([0, 0, 2]), np.array([1, 2, 1]))
    assert np.allclose(p, [-0.6, 1.0, -0.3]) and np.allclose(q, [-0.6, 0.5, 0.0])
