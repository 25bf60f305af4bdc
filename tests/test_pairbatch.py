"""The batch statistics of all generation metrics against text-by-text ones, whatever the limits of the batches."""

import random
from unittest import mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.functions import pairbatch as B
from glossa.functions import seqstats as S
from glossa.operators import textmetrics as TM
from test_seqstats import slow_bleu, slow_chrf

KEYS = TM.ROUGE_KEYS
WORDS = ["a", "B", "c3", "the", "The", "end.", "stop!", "(x)", "é,", "Kelvin", "日本", "-", "...", "a b"]
texts = st.one_of(st.none(), st.text("aB c.!,(éİK\t\n ", max_size=30),
                  st.lists(st.sampled_from(WORDS), max_size=120).map(" ".join))


def plain(rows):
    split = [(S.rouge_sentences(p), [S.rouge_sentences(r) for r in rs or []]) for p, rs in rows]
    bleu, chrf = [slow_bleu(p, rs, 3) for p, rs in rows], [slow_chrf(p, rs) for p, rs in rows]
    out = {"clip": [x[0] for x in bleu], "c": [x[1] for x in bleu], "rl": [x[2] for x in bleu]}
    out |= {n: [list(map(int, x[k])) for x in chrf] for k, n in enumerate(("match", "hyp", "ref"))}
    hits = [[S.lcs_hits(p, r, KEYS) for r in rs] for p, rs in split]
    out |= {"pl": [sum(map(len, p)) for p, _ in split], **{n: [[h[n] for h in hs] for hs in hits] for n in ("tl", "rougeL", "rougeLsum")}}
    for n in (1, 2):
        count = [(S.rouge_tokens(p), [S.rouge_tokens(r) for r in rs or []]) for p, rs in rows]
        out[f"rouge{n}"] = [[sum((grams(p, n) & grams(r, n)).values()) for r in rs] for p, rs in count]
    return out


def grams(units, n):
    from collections import Counter
    return Counter(tuple(units[i:i + n]) for i in range(len(units) - n + 1))


def same(rows):
    got = B.score([p for p, _ in rows], [rs for _, rs in rows], 3, True, KEYS)
    for name, want in plain(rows).items():
        assert [x if isinstance(x, int) else list(x) for x in got[name]] == want, name


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(texts, st.one_of(st.none(), st.lists(texts, max_size=6))), min_size=1, max_size=10), st.sampled_from([1, 3, 32]),
       st.sampled_from([4, 1 << 17]), st.sampled_from([8, 1 << 19]), st.sampled_from([50, 1 << 21]), st.integers(1, 6))
def test_every_statistic_equals_text_by_text(rows, few, units, steps, chars, systems):
    rows = rows + [(p, rows[0][1]) for p, _ in rows[:systems]]  # more systems on the references of the first row
    with mock.patch.multiple(B, FEW=few, SORT_UNITS=units, LANE_STEPS=steps, CHUNK_CHARS=chars):
        same(rows)


def test_long_sentences_and_large_alphabets():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(40)]
    lines = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "!"] if k % 2 else [""]) for _ in range(n))
             for k, n in enumerate((0, 1, 5, 63, 64, 65, 66, 127, 128, 129, 190, 256, 257, 300))]
    rows = [(a, [b, rng.choice(lines)]) for a in lines for b in lines]
    signs = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)) for _ in range(3)]
    with mock.patch.object(B, "FEW", 4):
        same(rows + [(signs[0] + signs[1][:50], signs)])


def test_more_windows_than_a_part_of_a_word_counts():
    many = [(t, ["ab " * 9, "a" * 6000 + " a" * 5000, "a a b"]) for t in ("a" * 5000, "a " * 4097, "b")]
    same(many + [(f"{k} a", many[0][1]) for k in range(5)])


def test_one_python_call_and_one_cut_a_row(spark):
    """Each metric tokenised all texts anew, ROUGE once for every copy of the prediction."""
    df = spark.createDataFrame([(1, "A", "the cat sat", ["a cat sat", "the cat"])], "row_id long, system string, "
                               "generated_text string, references array<string>")
    plan = TM.generation_scores(df, by="system")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
    with mock.patch.object(B, "rouge_tokens", wraps=B.rouge_tokens) as cut:
        B.score(["a b", "c d", "e"], [["x y", "z"]] * 3, 3, True, KEYS)
    assert [list(c.args[0]) for c in cut.call_args_list] == [["a b", "c d", "e", "x y", "z"]]


@pytest.mark.parametrize("rows", [[], [("a", [])], [(None, None), ("", [None, ""])], [("x", ["x"] * 9), ("y", ["x"])]])
def test_empty_and_many_references(spark, rows):
    if rows:
        same(rows)
    df = spark.createDataFrame([(i, "A", p, r) for i, (p, r) in enumerate(rows)],
                               "row_id long, system string, generated_text string, references array<string>")
    pairs = TM.rouge_pairs(df, carry=["row_id"]).select("row_id", "ref_idx", F.col("rouge1_fmeasure").alias("f")).collect()
    assert sorted((r.row_id, r.ref_idx) for r in pairs) == [(i, k) for i, (_, rs) in enumerate(rows) for k in range(len(rs or []))]
