"""N-gram counts and clipped matches for a whole Arrow batch of texts at once (BLEU, ROUGE-1/2, chrF++).

Texts become one flat array of unit ids (characters or tokens) with the text each unit belongs to. A window of n units
is one exact integer, ``id[i] * A^(n-1) + ... + id[i+n-1]``; where that would not fit 63 bits together with the text
number, shorter windows are first replaced by their rank among all windows of that length, which keeps them exact. One
``np.unique`` per order then counts (text, window), and matches of two texts are look-ups in the sorted result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from glossa.functions.seqstats import chrf_words, rouge_tokens, ws_tokens

# chrF++ orders and beta.
CHAR_ORDER = 6
WORD_ORDER = 2
BETA = 2.0
CHUNK_CHARS = 1 << 18  # the sorted windows of a chunk stay in a core's cache


class Counts:
    """Sorted (text, window) keys of one order with their counts, and the number of windows per text."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, span: int, n_texts: int):
        self.keys, self.counts, self.span = keys, counts, span
        text = keys // span if len(keys) else keys
        self.windows = keys - text * span
        self.bounds = np.searchsorted(text, np.arange(n_texts + 1))
        self.totals = np.bincount(text, weights=counts, minlength=n_texts).astype(np.int64)

    def entries(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry numbers, position in ``texts``) of all entries of the given texts."""
        n = self.bounds[texts + 1] - self.bounds[texts]
        which = np.repeat(np.arange(len(texts)), n)
        first = np.cumsum(n) - n
        return self.bounds[texts][which] + np.arange(len(which)) - first[which], which

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For text pairs (a[k], b[k]): (pair number, window, count in a, count in b) of every shared window."""
        entry, pair = self.entries(b)
        want = a[pair] * self.span + self.windows[entry]
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        hit = np.flatnonzero(self.keys[at] == want) if len(self.keys) else np.empty(0, np.int64)
        entry, pair, at = entry[hit], pair[hit], at[hit]
        return pair, self.windows[entry], self.counts[at], self.counts[entry]

    def matches(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Clipped matches per pair: the sum over windows of the smaller count."""
        pair, _, x, y = self.common(a, b)
        return np.bincount(pair, weights=np.minimum(x, y), minlength=len(a)).astype(np.int64)


def count_orders(ids: np.ndarray, text: np.ndarray, n_texts: int, orders: int) -> list[Counts]:
    """Counts of the windows of 1 to ``orders`` units; ``text`` (ascending) says whose unit it is."""
    if not len(ids):
        return [Counts(np.empty(0, np.int64), np.empty(0, np.int64), 1, n_texts)] * orders
    alphabet, base = np.unique(ids, return_inverse=True)
    size, key, span, out = len(alphabet), base.astype(np.int64), len(alphabet), []
    base = key
    for n in range(1, orders + 1):
        if n > 1:
            if span * size * n_texts >= 1 << 62:
                ranks, key = np.unique(key, return_inverse=True)
                span = len(ranks)
            key, span = key[:-1] * size + base[n - 1:], span * size
        owner = text[:len(key)]
        whole = owner == text[n - 1:]
        keys, counts = np.unique(owner[whole] * span + key[whole], return_counts=True)
        out.append(Counts(keys, counts, span, n_texts))
    return out


def chunks(sizes: Sequence[int], limit: int = CHUNK_CHARS):
    """Row ranges of about ``limit`` characters."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Texts:
    """Distinct texts of a chunk (references shared by several systems are counted once)."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def add(self, text: str | None) -> int:
        return self.number.setdefault(text or "", len(self.number))

    def __len__(self) -> int:
        return len(self.number)

    def tokens(self, split) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, owner) of all texts."""
        known: dict[str, int] = {}
        ids, size = [], []
        for t in self.number:
            own = [known.setdefault(w, len(known)) for w in split(t)]
            ids += own
            size.append(len(own))
        return np.array(ids, dtype=np.int64), np.repeat(np.arange(len(size)), size)

    def characters(self) -> tuple[np.ndarray, np.ndarray]:
        """(code points, owner) of all texts without spaces."""
        plain = [t.replace(" ", "") for t in self.number]
        ids = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        return ids, np.repeat(np.arange(len(plain)), [len(t) for t in plain])


def _rows(pred, refs) -> tuple[list, list]:
    return list(pred), [list(r) if r is not None else [] for r in refs]


def _sizes(pred, refs) -> list[int]:
    return [len(p or "") + sum(len(r or "") for r in rs) for p, rs in zip(pred, refs)]


def _pairs(texts: Texts, pred, refs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prediction text, reference text, row) of every (row, reference)."""
    own = [texts.add(p) for p in pred]
    flat = [(own[i], texts.add(r), i) for i, rs in enumerate(refs) for r in rs]
    a = np.array(flat, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def bleu_rows(pred, refs, n_max: int) -> list[tuple[list[int], int, list[int]]]:
    """Per row: clipped matches of orders 1..n_max (a window counts as often as in the reference that has it most), the
    prediction's token count, and each reference's."""
    pred, refs = _rows(pred, refs)
    out = []
    for i, j in chunks(_sizes(pred, refs)):
        texts = Texts()
        a, b, row = _pairs(texts, pred[i:j], refs[i:j])
        orders = count_orders(*texts.tokens(ws_tokens), len(texts), n_max)
        clip = np.zeros((j - i, n_max), dtype=np.int64)
        for n, counts in enumerate(orders):
            pair, window, x, y = counts.common(a, b)
            if not len(pair):
                continue
            group = row[pair] * counts.span + window
            order = np.argsort(group, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) != 0)))
            best = np.maximum.reduceat(np.minimum(x, y)[order], first)
            clip[:, n] = np.bincount(row[pair][order][first], weights=best, minlength=j - i)
        total = orders[0].totals
        length = [total[texts.add(p)] for p in pred[i:j]]
        at = np.searchsorted(row, np.arange(j - i + 1))
        out += [(clip[k].tolist(), int(length[k]), total[b[at[k]:at[k + 1]]].tolist()) for k in range(j - i)]
    return out


def rouge_n_pairs(pred, ref, orders: int = 2) -> list[np.ndarray]:
    """Clipped matches of orders 1..``orders`` of every (prediction, reference) pair of normalised texts."""
    pred, ref = list(pred), list(ref)
    out = [[] for _ in range(orders)]
    for i, j in chunks([len(p or "") + len(r or "") for p, r in zip(pred, ref)]):
        texts = Texts()
        a = np.array([texts.add(p) for p in pred[i:j]], dtype=np.int64)
        b = np.array([texts.add(r) for r in ref[i:j]], dtype=np.int64)
        for n, counts in enumerate(count_orders(*texts.tokens(rouge_tokens), len(texts), orders)):
            out[n].append(counts.matches(a, b))
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


def chrf_rows(pred, refs) -> list[tuple[list[int], list[int], list[int]]]:
    """Per row (match, hypothesis, reference) counts by order (characters 1..6, words 1..2) for the best reference by
    sentence F; the first wins ties, and if all score 0 only the hypothesis counts are given."""
    pred, refs = _rows(pred, refs)
    out = []
    for i, j in chunks(_sizes(pred, refs)):
        texts = Texts()
        a, b, row = _pairs(texts, pred[i:j], refs[i:j])
        own = np.array([texts.add(p) for p in pred[i:j]], dtype=np.int64)
        orders = count_orders(*texts.characters(), len(texts), CHAR_ORDER) \
            + count_orders(*texts.tokens(chrf_words), len(texts), WORD_ORDER)
        hyp = np.stack([c.totals[own] for c in orders], axis=1)
        best = [(0.0, None)] * (j - i)
        if len(a):
            match = np.stack([c.matches(a, b) for c in orders], axis=1)
            have = np.stack([c.totals[b] for c in orders], axis=1)
            for k, (f, r) in enumerate(zip(fscores(match, hyp[row], have), row)):
                if f > best[r][0]:
                    best[r] = (f, k)
        none = [0] * len(orders)
        for r in range(j - i):
            k = best[r][1]
            out.append((none if k is None else match[k].tolist(), hyp[r].tolist(), none if k is None else have[k].tolist()))
    return out


def fscores(match: np.ndarray, hyp: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Sentence F per row: the mean over orders of F_beta (0 where an order has no window)."""
    b2 = BETA * BETA
    p = match / np.where(hyp > 0, hyp, 1)
    r = match / np.where(ref > 0, ref, 1)
    den = b2 * p + r
    f = (1 + b2) * p * r / np.where(den > 0, den, 1.0)
    total = np.zeros(len(match))
    for o in range(match.shape[1]):  # in order, as the formula is written
        total = total + f[:, o]
    return total / match.shape[1]
