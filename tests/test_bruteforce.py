"""Queries without a SQL twin (ROUGE-L, ROUGE-Lsum and the reports that contain
them) against a brute-force implementation on the smallest tables.

The brute force is the textbook one: a full LCS dynamic-programming table per
pair (per sentence pair for ROUGE-Lsum) with the published union-LCS
backtracking rule, plain ``Counter`` n-gram overlaps, and Python's ``re`` for
normalisation. It shares no code with ``glossa.functions.seqstats`` (which uses
the bit-parallel recurrence) and runs on every pair of the fixture, whole lines.
"""

import re
from collections import Counter

import pytest

from conftest import SF_SMALL
from glossa.plans import REGISTRY
from glossa.sources import fixtures as V

_SENT = re.compile(r"(?<=[.!?])\s+", re.ASCII)


def rtok(text):
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def sents(text):
    return [s for s in _SENT.split(text.strip()) if s != ""]


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        ai, row, prev = a[i - 1], t[i], t[i - 1]
        for j in range(1, len(b) + 1):
            row[j] = prev[j - 1] + 1 if ai == b[j - 1] else max(prev[j], row[j - 1])
    return t


def lcs_ref_positions(ref, can):
    """Reference indices of one LCS; the candidate index moves only when that is strictly better."""
    t = lcs_table(ref, can)
    i, j, out = len(ref), len(can), []
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def prf(hits, pl, rl):
    if pl == 0 or rl == 0:
        return 0.0, 0.0, 0.0
    p, r = hits / pl, hits / rl
    return p, r, (2 * p * r / (p + r) if p + r > 0 else 0.0)


def overlap(a, b):
    ca, cb = Counter(a), Counter(b)
    return sum(min(v, cb[k]) for k, v in ca.items())


def bigrams(t):
    return list(zip(t, t[1:]))


def pair_scores(pred, ref):
    p, r = rtok(pred), rtok(ref)
    out = {"rouge1": prf(overlap(p, r), len(p), len(r)),
           "rouge2": prf(overlap(bigrams(p), bigrams(r)), len(p) - 1 if p else 0, len(r) - 1 if r else 0)}
    out["rougeL"] = prf(lcs_table(p, r)[len(p)][len(r)], len(p), len(r))
    ps, rs = [rtok(s) for s in sents(pred)], [rtok(s) for s in sents(ref)]
    left_p, left_r = Counter(x for s in ps for x in s), Counter(x for s in rs for x in s)
    hits = 0
    for rsent in rs:
        union = sorted(set().union(*[lcs_ref_positions(rsent, c) for c in ps])) if ps else []
        for k in union:
            tok = rsent[k]
            if left_p[tok] > 0 and left_r[tok] > 0:
                hits += 1
                left_p[tok] -= 1
                left_r[tok] -= 1
    out["rougeLsum"] = prf(hits, sum(map(len, ps)), sum(map(len, rs)))
    return out


@pytest.fixture(scope="module")
def brute(spark):
    """Mean P/R/F per (system, key) over all 3N pairs, and mean generated length."""
    rows = V.gen_eval(spark, SF_SMALL).select("system", "generated_text", "references").collect()
    sums, n, glen = Counter(), Counter(), Counter()
    for row in rows:
        glen[row.system] += len(row.generated_text.split())
        for ref in row.references:
            n[row.system] += 1
            for key, vals in pair_scores(row.generated_text, ref).items():
                for m, v in zip(("precision", "recall", "fmeasure"), vals):
                    sums[(row.system, f"{key}_{m}")] += v
    means = {k: v / n[k[0]] for k, v in sums.items()}
    gen_len = {s: glen[s] / (n[s] / 3) for s in glen}
    return means, gen_len


def _check(got: dict, want: dict, tol=1e-6):
    assert set(got) == set(want)
    bad = {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) > tol}
    assert not bad, bad


def test_rouge_l_matches_brute_force(spark, brute):
    means, _ = brute
    got = {(r.system, c): r[c] for r in REGISTRY["f5_rouge_l"].fn(spark, SF_SMALL).collect()
           for c in r.asDict() if c != "system"}
    _check(got, {k: v for k, v in means.items() if k[1].startswith("rougeL_")})


def test_rouge_lsum_matches_brute_force(spark, brute):
    means, _ = brute
    got = {(r.system, c): r[c] for r in REGISTRY["f6_rouge_lsum"].fn(spark, SF_SMALL).collect()
           for c in r.asDict() if c != "system"}
    _check(got, {k: v for k, v in means.items() if k[1].startswith("rougeLsum_")})


def _report(spark, name):
    return {(r.system, r.metric): r.value for r in REGISTRY[name].fn(spark, SF_SMALL).collect()}


def _component_values(spark):
    """Values the report must repeat, from queries that match their SQL twins."""
    out = {}
    for r in REGISTRY["f2_bleu"].fn(spark, SF_SMALL).collect():
        out[(r.system, "test/blue")] = r.bleu
    for r in REGISTRY["f3_chrf"].fn(spark, SF_SMALL).collect():
        out[(r.system, "test/chrf")] = r.chrf
    for r in REGISTRY["f4_rouge_n"].fn(spark, SF_SMALL).collect():
        for c, v in r.asDict().items():
            if c != "system":
                out[(r.system, f"test/rouge/{c}")] = v
    return out


def test_test_report_matches_components_and_brute_force(spark, brute):
    means, _ = brute
    rep = _report(spark, "f11_test_report")
    want = _component_values(spark)
    want.update({(s, f"test/rouge/{k}"): v for (s, k), v in means.items() if k.startswith("rougeL")})
    _check({k: rep[k] for k in want}, want)
    for (s, k), v in means.items():  # ROUGE-1/2 also equal the brute force
        assert rep[(s, f"test/rouge/{k}")] == pytest.approx(v, abs=1e-6)
    assert {m for _, m in rep} >= {"test/acc", "test/f1", "test/bert/f1"}


def test_scaled_report_matches_brute_force(spark, brute):
    means, gen_len = brute
    got = _report(spark, "f12_scaled_report")
    want = {(s, k): round(means[(s, f"{k}_fmeasure")] * 100, 4) for s in gen_len
            for k in ("rouge1", "rouge2", "rougeL", "rougeLsum")}
    want.update({(s, "gen_len"): round(v, 4) for s, v in gen_len.items()})
    _check(got, want, tol=1.5e-4)


def test_stream_metrics_equal_batch_report(spark):
    """Two epochs, each of which starts the metrics anew: the stream equals the batch metrics by epoch."""
    from pyspark.sql import functions as F

    from glossa.operators import textmetrics as T
    from glossa.sources import fixtures as V
    g = V.gen_eval(spark, SF_SMALL).withColumn("epoch", (F.col("row_id") % 2).cast("int"))
    batch = T.to_long(T.generation_scores(g, by=["system", "epoch"]), ["system", "epoch"], T.report_names()).collect()
    stream = REGISTRY["i1_stream_metrics"].fn(spark, SF_SMALL).collect()
    got = {(r.system, r.epoch, r.metric): r.value for r in stream}
    assert {e for _, e, _ in got} == {0, 1} and len(got) == len(stream)
    _check(got, {(r.system, r.epoch, r.metric): r.value for r in batch})
