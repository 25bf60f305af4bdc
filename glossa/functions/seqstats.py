"""Per-text tokenisers equal to the native expressions, and the sequential text statistic that Spark's array
functions cannot express in linear time: LCS length and LCS-matched positions (ROUGE-L / ROUGE-Lsum) with the
bit-parallel row recurrence V' = (V + U) | (V - U), U = V & match(t): one machine-word pass per predicted token
instead of an O(m·n) table of lambdas. (N-gram counts are in ``ngrambatch``.)

They run inside Arrow-batched pandas UDFs on Spark partitions (see
``glossa.operators.textmetrics``); nothing here touches Spark.
"""

from __future__ import annotations

import re
from collections import Counter

_PUNCT = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

# The tokenisation of ``glossa.functions.text`` in Python ``re``. Java's ``\s`` (no
# Unicode flag) is exactly [ \t\n\x0B\f\r]; Spark's ``trim`` strips spaces only; empties are
# dropped. tests/test_seqstats.py checks token-for-token equality with the Spark expressions.
_WS = re.compile(r"[ \t\n\x0b\f\r]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+")
_ALNUM = re.compile(r"[a-z0-9]+")


def ws_tokens(text) -> list[str]:
    """``text.tokens``: whitespace tokens, no empties ([] for None)."""
    return [t for t in _WS.split(text) if t] if text else []


def rouge_tokens(text) -> list[str]:
    """``text.rouge_tokens``: lower case, runs outside [a-z0-9] separate tokens."""
    return _ALNUM.findall(text.lower()) if text else []


def rouge_sentences(text) -> list[list[str]]:
    """``transform(text.sentences, rouge_tokens)``."""
    return [rouge_tokens(s) for s in _SENTENCE.split(text.strip(" ")) if s] if text else []


def _masks(target) -> dict:
    masks: dict = {}
    for j, t in enumerate(target):
        masks[t] = masks.get(t, 0) | (1 << j)
    return masks


def _rows(pred, target, masks=None):
    """Match bits m_1..m_k and bit rows V_1..V_k over target positions; bit j of a row set = no LCS step at j. Of
    neighbouring tokens that the target lacks, the first stands for all: their rows are equal and match nothing."""
    masks = _masks(target) if masks is None else masks
    full = (1 << len(target)) - 1
    v, last = full, 1
    hits, rows = [], []
    for t in pred:
        m = masks.get(t, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
        elif not last:
            continue
        last = m
        hits.append(m)
        rows.append(v)
    return hits, rows


def lcs_length(pred, target) -> int:
    if pred is None or target is None or len(pred) == 0 or len(target) == 0:
        return 0
    masks = _masks(target)
    full = (1 << len(target)) - 1
    v = full
    for t in pred:
        m = masks.get(t)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(target) - v.bit_count()


def lcs_target_positions(pred, target, masks=None) -> list[int]:
    """Target positions of one LCS, backtracking from the end; on a tie the
    prediction index moves first only when that keeps a strictly longer LCS.
    ``masks`` (``_masks(target)``) may be passed when the target is reused."""
    i, j = len(pred), len(target)
    out: list[int] = []
    while i > 0 and j > 0 and pred[i - 1] == target[j - 1]:  # a common end is matched whatever the rows say
        i -= 1
        j -= 1
        out.append(j)
    if i > 0 and j > 0:
        below = (1 << j) - 1
        hits, rows = _rows(pred[:i], target, masks)  # a row's low bits do not depend on its high ones
        for m, v in zip(reversed(hits), reversed(rows)):
            # for two different tokens L(i, j) is the larger of L(i - 1, j) and L(i, j - 1): where the row steps at j,
            # L(i, j - 1) is less, so L(i - 1, j) is the larger; elsewhere it is not. So j goes down to the next match
            # or step, and then i does
            j = ((~v | m) & below).bit_length()
            if not j:
                break
            if m >> (j - 1) & 1:
                j -= 1
                out.append(j)
            below = (1 << j) - 1
    out.reverse()
    return out


def lcs_hits(pred_sents, target_sents, keys) -> dict:
    """ROUGE-L / ROUGE-Lsum hits and token counts of one (prediction, reference) pair, from sentence-split
    normalised tokens (the flattened sentences are the text's tokens)."""
    p = [t for s in pred_sents for t in s]
    t = [x for s in target_sents for x in s]
    out = {"pl": len(p), "tl": len(t)}
    if "rougeL" in keys:
        out["rougeL"] = lcs_length(p, t)
    if "rougeLsum" in keys:
        out["rougeLsum"] = union_lcs_hits(pred_sents, target_sents)
    return out


def union_lcs_hits(pred_sents, target_sents) -> int:
    """ROUGE-Lsum hits: for each target sentence, the union of its LCS-matched
    positions over all predicted sentences; each token type is consumed at most
    as often as it occurs in both texts."""
    pred_sents = [list(s) for s in (pred_sents if pred_sents is not None else [])]
    target_sents = [list(s) for s in (target_sents if target_sents is not None else [])]
    if sum(map(len, pred_sents)) == 0 or sum(map(len, target_sents)) == 0:
        return 0
    pred_left = Counter(t for s in pred_sents for t in s)
    target_left = Counter(t for s in target_sents for t in s)
    pred_sets = [set(p) for p in pred_sents]
    hits = 0
    for tgt in target_sents:
        masks = _masks(tgt)  # once per target sentence, shared by every predicted sentence
        # positions an LCS can reach: target tokens that occur somewhere in the prediction
        reachable = sum(1 for t in tgt if t in pred_left)
        union: set[int] = set()
        for p, ps in zip(pred_sents, pred_sets):
            if len(union) == reachable:
                break  # nothing left to add
            if ps.isdisjoint(masks):
                continue  # LCS 0: contributes no position
            union.update(lcs_target_positions(p, tgt, masks))
        for pos in sorted(union):
            tok = tgt[pos]
            if pred_left[tok] > 0 and target_left[tok] > 0:
                hits += 1
                pred_left[tok] -= 1
                target_left[tok] -= 1
    return hits


def chrf_words(text) -> list[str]:
    """``text.chrf_words``: whitespace tokens with one trailing, else leading, punctuation mark split off."""
    out: list[str] = []
    for w in ws_tokens(text):
        if len(w) == 1:
            out.append(w)
        elif w[-1] in _PUNCT:
            out.extend((w[:-1], w[-1]))
        elif w[0] in _PUNCT:
            out.extend((w[0], w[1:]))
        else:
            out.append(w)
    return out
