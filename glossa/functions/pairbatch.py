"""All generation statistics of an Arrow batch (BLEU, chrF++, ROUGE-1/2/L/Lsum) from one tokenisation, by array operations.

Rows with equal references form a group, so a reference is cut and counted once for all systems. Tokens are runs of bytes
of a class, numbered exactly by an Arrow dictionary. The windows of all orders come from one sort: a window of the highest
order is an integer of (group, units, text of the group), its prefixes are the windows of the lower orders, and what a
text lacks at its end is the unit 0. LCS runs on 64-bit words, one lane a pair (ROUGE-L) or a predicted sentence and a word
of whole target sentences (ROUGE-Lsum), all lanes a step together. What does not fit (many references, alphabets too large
for a word, sentences of more than 64 tokens, the few longest lanes) takes the ways of ``ngrambatch`` and ``seqstats``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from glossa.functions import ngrambatch, seqstats
from glossa.functions.ngrambatch import CHAR_ORDER, WORD_ORDER, chunks

CHUNK_CHARS = 1 << 21  # characters whose lanes step together
SORT_UNITS = 1 << 16  # units whose windows are sorted together: they stay in a core's cache
SIDE = 4  # predictions and references of a group, at most; a text's number in it takes 3 bits
LANE_STEPS = 1 << 19  # steps of lanes whose rows are held together
FEW = 32  # lanes that are not worth an array operation a step
WORDS = 4  # words of a reference whose LCS is counted by array operations

_SPACE, _ALNUM, _PUNCT, _END = (np.zeros(256, dtype=bool) for _ in range(4))
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_ALNUM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_PUNCT[[ord(c) for c in seqstats._PUNCT]] = True
_END[list(b".!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_ONE = np.uint64(1)
_TO_ASCII = "\u0130\u212a"  # the letters beyond ASCII whose lower case holds one of a-z


def _encoded(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))


class Tokens:
    """Token numbers of all texts in order, the text of each and its first byte."""

    def __init__(self, data: np.ndarray, first: np.ndarray, owner: np.ndarray, at: np.ndarray):
        self.owner, self.at, self.data, self.first = owner, at, data, first
        ends = np.append(first, len(data)).astype(np.int64)
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)]) \
            .dictionary_encode()
        self.ids = self.words.indices.to_numpy().astype(np.int64)


def cut(data: np.ndarray, begin: np.ndarray, inside: np.ndarray) -> Tokens:
    """The runs of bytes of the class ``inside``; a text's end ends a run."""
    flag = inside[data]
    new = flag.copy()
    new[1:] &= ~flag[:-1]
    edge = begin[:-1][begin[:-1] < len(data)]
    new[edge] = flag[edge]
    at = np.flatnonzero(new)
    return Tokens(data[flag], np.flatnonzero(new[flag]), np.searchsorted(begin, at, "right") - 1, at)


def ws_tokens(texts: Sequence[str]) -> Tokens:
    """``seqstats.ws_tokens`` of every text."""
    return cut(*_encoded(texts), ~_SPACE)


def chrf_words(tokens: Tokens) -> Tokens:
    """``seqstats.chrf_words`` from the whitespace tokens."""
    first, end = tokens.first, np.append(tokens.first, len(tokens.data))[1:]
    more = end - first > 1
    tail = more & _PUNCT[tokens.data[end - 1]]
    head = more & ~tail & _PUNCT[tokens.data[first]]
    cuts = np.where(tail, end - 1, first + 1)
    split = tail | head
    new = np.zeros(len(tokens.data), dtype=bool)
    new[first] = True
    new[cuts[split]] = True
    return Tokens(tokens.data, np.flatnonzero(new), np.repeat(tokens.owner, 1 + split), np.repeat(tokens.at, 1 + split))


def rouge_tokens(texts: Sequence[str]) -> tuple[Tokens, np.ndarray]:
    """``seqstats.rouge_tokens`` of every text and the number of the sentence that each lies in."""
    whole = any(c in t for t in texts for c in _TO_ASCII)
    data, begin = _encoded([t.lower() for t in texts] if whole else texts)
    data = _LOWER[data]
    tokens = cut(data, begin, _ALNUM)
    brk = _SPACE[data]
    brk[1:] &= _END[data[:-1]]
    brk[:1] = False
    return tokens, np.cumsum(brk)[tokens.at] if len(data) else tokens.at


class Groups:
    """Rows with equal references, and their texts: of each group its predictions, then its references."""

    def __init__(self, pred: Sequence[str], refs: Sequence[Sequence[str]]):
        opened: dict[tuple, int] = {}
        preds, self.refs, row = [], [], []
        for p, rs in zip(pred, refs):
            rs = tuple(rs)
            g = opened.get(rs)
            if g is None or len(preds[g]) == SIDE:
                g = opened[rs] = len(preds)
                preds.append([])
                self.refs.append(rs)
            row.append((g, len(preds[g])))
            preds[g].append(p)
        self.n = len(preds)
        self.texts = [t for ps, rs in zip(preds, self.refs) for t in (*ps, *rs)]
        n_p, n_r = (np.array([len(x) for x in xs], dtype=np.int64) for xs in (preds, self.refs))
        size = n_p + n_r
        self.begin = np.concatenate(([0], np.cumsum(size)))
        self.group = np.repeat(np.arange(self.n), size)
        k = np.arange(len(self.group)) - self.begin[self.group]
        self.slot = np.where(k < n_p[self.group], k, SIDE + k - n_p[self.group])
        self.row = np.array(row, dtype=np.int64).reshape(-1, 2)
        self.n_refs = n_r[self.row[:, 0]]
        self.pred = self.begin[self.row[:, 0]] + self.row[:, 1]
        self.ref = self.begin[self.row[:, 0]] + n_p[self.row[:, 0]]  # text of the first reference

    def lengths(self, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, minlength=len(self.texts)).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, prediction text, reference text) of every pair, by row."""
        row = np.repeat(np.arange(len(self.row)), self.n_refs)
        k = np.arange(len(row)) - np.repeat(np.cumsum(self.n_refs) - self.n_refs, self.n_refs)
        return row, self.pred[row], self.ref[row] + k


def _sorted_windows(ids: np.ndarray, owner: np.ndarray, groups: Groups, orders: int,
                    dense: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]] | None:
    """Sorted keys (group, ``orders`` units, number ``dense`` of the text in it) of parts of the groups, the bits of a unit
    and the part's first group; None if they don't fit a word."""
    bits = int(ids.max(initial=0) + 1).bit_length()
    room = 64 - 3 - orders * bits
    if room < 4:
        return None

    def parts():
        units, slot = ids.astype(np.uint64) + _ONE, dense[groups.slot].astype(np.uint64)
        begin = np.searchsorted(owner, np.arange(len(groups.texts) + 1))
        first = begin[groups.begin]  # first unit of each group
        g = 0
        while g < groups.n:
            to = min(g + (1 << min(room, 30)), max(g + 1, int(np.searchsorted(first, first[g] + SORT_UNITS, "right")) - 1), groups.n)
            a, z = int(first[g]), int(first[to])
            if z > a:
                key, have = np.zeros(z - a + 2 * orders, dtype=np.uint64), 1
                key[:z - a] = units[a:z]
                while have < orders:
                    more = min(have, orders - have)
                    nxt = key[have:] >> np.uint64((have - more) * bits)  # the first ``more`` units of the next window
                    key = (key[:len(nxt)] << np.uint64(more * bits)) | nxt
                    have += more
                key = key[:z - a]
                texts = slice(int(groups.begin[g]), int(groups.begin[to]))
                start, end = begin[texts] - a, begin[texts.start + 1:texts.stop + 1] - a
                for d in range(1, orders):  # the window d before a text's end has d units
                    at = (end - d)[end - d >= start]
                    key[at] &= np.uint64(((1 << d * bits) - 1) << (orders - d) * bits)
                head = ((groups.group[texts] - g).astype(np.uint64) << np.uint64(orders * bits + 3)) | slot[texts]
                key <<= np.uint64(3)
                key |= np.repeat(head, end - start)
                key.sort()
                yield key, bits, g
            g = to
    return parts()


def match_windows(ids: np.ndarray, owner: np.ndarray, groups: Groups, orders: int, best: bool = False) -> np.ndarray | None:
    """Clipped matches of orders 1..``orders`` by (order, group, prediction, reference), or (order, group, prediction) if
    ``best``: a window then counts as often as in the reference that has it most. None if the windows don't fit a word."""
    out = np.zeros((orders, groups.n, SIDE) + (() if best else (SIDE,)), dtype=np.int64)
    used = np.flatnonzero(np.bincount(groups.slot, minlength=2 * SIDE))
    dense = np.zeros(2 * SIDE, dtype=np.int64)
    dense[used] = np.arange(len(used))
    parts = _sorted_windows(ids, owner, groups, orders, dense)
    if parts is None:
        return None
    n_pred = int((used < SIDE).sum())
    if not n_pred or n_pred == len(used):
        return out
    # a number of windows a text, side by side in a word
    width = min(64 // len(used), 62)
    one = _ONE << (np.arange(8, dtype=np.uint64) * np.uint64(width))
    shift = np.arange(len(used), dtype=np.uint64)[:, None] * np.uint64(width)
    low = np.uint64((1 << width) - 1)
    in_pred, in_ref = (np.bitwise_or.reduce((low << shift)[at, 0]) for at in (slice(n_pred), slice(n_pred, None)))
    for key, bits, g in parts:
        unit, slot = np.uint64((1 << bits) - 1), (key & np.uint64(7)).astype(np.intp)
        before = np.zeros(len(key) + 1, dtype=np.uint64)  # windows before each; sums may run over, their differences don't
        np.cumsum(one[slot], out=before[1:])
        for n in range(1, orders + 1):
            win = key >> np.uint64(3 + (orders - n) * bits)
            new = np.empty(len(win) + 1, dtype=bool)
            new[0] = new[-1] = True
            np.not_equal(win[1:], win[:-1], out=new[1:-1])
            first = np.flatnonzero(new)
            if int(np.diff(first).max()) <= int(low):
                packed = np.diff(before[first])
                win = win[first[:-1]]
                # what a prediction and a reference share, and is no shorter than the order
                both = np.flatnonzero(((packed & in_pred) != 0) & ((packed & in_ref) != 0) & ((win & unit) != 0))
                win = win[both]
                counts = ((packed[both] >> shift) & low).astype(np.int64)
            else:
                size = len(first) - 1
                counts = np.bincount(slot * size + np.cumsum(new[:-1]) - 1, minlength=len(used) * size).reshape(len(used), size)
                win = win[first[:-1]]
                both = np.flatnonzero((win & unit) != 0)
                win, counts = win[both], counts[:, both]
            if not len(win):
                continue
            own = win >> np.uint64(n * bits)
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            at = own[start].astype(np.int64) + g
            top = counts[n_pred:].max(axis=0) if best else None
            for k, p in enumerate(used[:n_pred]):
                if best:
                    out[n - 1, at, p] = np.add.reduceat(np.minimum(counts[k], top), start)
                    continue
                for j, r in enumerate(used[n_pred:] - SIDE, start=n_pred):
                    out[n - 1, at, p, r] = np.add.reduceat(np.minimum(counts[k], counts[j]), start)
    return out


# ---- LCS -----------------------------------------------------------------------


def _spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, element) of all elements of the ranges start..start + size."""
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]


def _blocks(steps: np.ndarray) -> Iterator[tuple[int, int]]:
    return chunks(steps.tolist(), LANE_STEPS)


def _steps(hit: np.ndarray) -> np.ndarray:
    """The steps to take where ``hit`` says which tokens occur in the target: of a run of others the first will do, as
    the rows of the next ones are equal and match nothing."""
    keep = hit.copy()
    keep[1:] |= hit[:-1]
    keep[:1] = True
    return np.flatnonzero(keep)


def _matched(hits: list[int], mask: int, near: list[int]) -> int:
    """The bits of whole sentences in a word that an LCS with the sentence of the tokens ``hits`` matches."""
    v, rows = mask, []
    for h in hits:
        if h:
            u = v & h
            v = ((v + u) | (v ^ u)) & mask
        rows.append(v)
    below, out = mask, 0
    for h, v in zip(reversed(hits), reversed(rows)):
        x = (~v | h) & below
        for k, keep in enumerate(near):
            x |= (x >> (1 << k)) & keep
        if h:
            top = x & ~((x >> 1) & near[0]) & h
            out |= top
            x ^= top
        below = x
        if not below:
            break
    return out


class Lcs:
    """Tokens of the texts of groups, numbered within each group, and what ROUGE-L and ROUGE-Lsum count of them."""

    def __init__(self, tokens: Tokens, sentence: np.ndarray, groups: Groups):
        span = int(tokens.ids.max(initial=0)) + 1
        group = groups.group[tokens.owner]
        keys, inverse = np.unique(group * span + tokens.ids, return_inverse=True)
        kinds = np.searchsorted(keys, np.arange(groups.n + 1) * span)
        self.local = inverse - kinds[group]
        self.kinds = np.diff(kinds)[groups.group]  # of each text: distinct tokens of its group
        self.owner, self.sentence = tokens.owner, sentence
        self.begin = np.searchsorted(tokens.owner, np.arange(len(groups.texts) + 1))
        self.size = np.diff(self.begin)
        self.row, self.p, self.r = groups.pairs()

    def _table(self, word: np.ndarray, bit: np.ndarray, token: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each kind of token in each word (of the texts ``text``), and where a word's kinds begin."""
        off = np.concatenate(([0], np.cumsum(self.kinds[text])))
        table = np.zeros(int(off[-1]), dtype=np.uint64)
        np.add.at(table, off[word] + self.local[token], _ONE << bit.astype(np.uint64))  # a word has each bit once
        return table, off[:-1]

    def _list(self, a: int, z: int) -> list[int]:
        return self.local[a:z].tolist()

    def lengths(self) -> np.ndarray:
        """LCS length of every pair."""
        out = np.zeros(len(self.row), dtype=np.int64)
        m, n = self.size[self.p], self.size[self.r]
        for w in range(1, WORDS + 1):
            some = np.flatnonzero((m > 0) & (n > 64 * (w - 1)) & (n <= 64 * w))
            for i, j in _blocks(m[some] * w):
                self._lengths(some[i:j], w, out)
        for k in np.flatnonzero((m > 0) & (n > 64 * WORDS)):
            self._one_length(k, out)
        return out

    def _one_length(self, k: int, out: np.ndarray) -> None:
        a, b = self.begin[self.p[k]], self.begin[self.r[k]]
        out[k] = seqstats.lcs_length(self._list(a, a + self.size[self.p[k]]), self._list(b, b + self.size[self.r[k]]))

    def _lengths(self, pairs: np.ndarray, w: int, out: np.ndarray) -> None:
        pairs = pairs[np.argsort(-self.size[self.p[pairs]], kind="stable")]
        long = self.size[self.p[pairs]]
        steps = int(long[FEW - 1]) if len(long) >= FEW else 0  # from there on fewer than FEW lanes go on
        lone = int(np.searchsorted(-long, -steps, "left"))
        for k in pairs[:lone]:
            self._one_length(k, out)
        pairs, long = pairs[lone:], long[lone:]
        if not len(pairs):
            return
        refs, back = np.unique(self.r[pairs], return_inverse=True)
        which, token = _spans(self.begin[refs], self.size[refs])
        at = token - self.begin[refs][which]
        table, off = self._table(which * w + (at >> 6), at & 63, token, np.repeat(refs, w))
        off = off.reshape(-1, w)[back].T.copy()
        start = self.begin[self.p[pairs]]
        rows = [np.full(len(pairs), ~np.uint64(0)) for _ in range(w)]
        active = np.searchsorted(-long, -np.arange(steps), "left")  # lanes longer than the step
        for i in range(steps):
            a = active[i]
            token, carry = self.local[start[:a] + i], None
            for x in range(w):
                v = rows[x][:a]
                u = v & table[off[x][:a] + token]
                total = v + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                rows[x][:a] = total | (v ^ u)
                carry = over.astype(np.uint64) if x + 1 < w else None
        # bits beyond the reference stay set
        out[pairs] = 64 * w - sum(np.bitwise_count(v).astype(np.int64) for v in rows)

    def union_hits(self) -> np.ndarray:
        """ROUGE-Lsum hits of every pair: the target positions that an LCS with some predicted sentence matches, of each
        kind of token at most as many as the prediction has."""
        out = np.zeros(len(self.row), dtype=np.int64)
        if not len(self.local) or not len(self.row):
            return out
        new = np.concatenate(([True], (self.owner[1:] != self.owner[:-1]) | (self.sentence[1:] != self.sentence[:-1])))
        seg = np.flatnonzero(new)
        seg_size = np.diff(np.append(seg, len(self.local)))
        seg_text = self.owner[seg]
        seg_begin = np.searchsorted(seg_text, np.arange(len(self.size) + 1))
        # whole sentences of a reference side by side in words, a bit between two takes the carry of the first
        is_ref = np.zeros(len(self.size), dtype=bool)
        is_ref[self.r] = True
        word_text, seg_word, seg_bit = [], np.full(len(seg), -1, dtype=np.int64), np.zeros(len(seg), dtype=np.int64)
        last, at, long = -1, 0, {}
        for s in np.flatnonzero(is_ref[seg_text]).tolist():
            t, size = int(seg_text[s]), int(seg_size[s])
            if size > 64:
                long.setdefault(t, []).append(s)
                continue
            if t != last or at + size > 64:
                word_text.append(t)
                last, at = t, 0
            seg_word[s], seg_bit[s] = len(word_text) - 1, at
            at += size + 1
        word_text = np.array(word_text, dtype=np.int64)
        which, token = _spans(seg, np.where(seg_word >= 0, seg_size, 0))
        tok_word = np.full(len(self.local), -1, dtype=np.int64)  # in no word: a prediction's or a long sentence's
        tok_bit = np.zeros(len(self.local), dtype=np.int64)
        tok_word[token], tok_bit[token] = seg_word[which], seg_bit[which] + token - seg[which]
        full = np.zeros(len(word_text), dtype=np.uint64)
        np.add.at(full, tok_word[token], _ONE << tok_bit[token].astype(np.uint64))
        word_begin = np.searchsorted(word_text, np.arange(len(self.size) + 1))

        m = self.size[self.p]
        sure = np.where(m > 0, np.diff(word_begin)[self.r], 0)
        pw_pair, pw_word = _spans(word_begin[self.r], sure)
        pw_begin = np.cumsum(sure) - sure
        union = np.zeros(len(pw_pair), dtype=np.uint64)
        place = tok_word, tok_bit, int(seg_size[seg_word >= 0].max(initial=0))
        for i, j in _blocks(m[pw_pair]):
            self._union(pw_pair[i:j], pw_word[i:j], union[i:j], seg, seg_size, seg_begin, word_text, full, place)

        for i, j in _blocks(m + self.size[self.r] + self.kinds[self.r]):
            pair = np.arange(i, j)
            off = np.concatenate(([0], np.cumsum(self.kinds[self.r[pair]])))
            which, token = _spans(self.begin[self.r[pair]], np.where(m[pair] > 0, self.size[self.r[pair]], 0))
            inside = tok_word[token] >= 0
            spot = np.where(inside, pw_begin[pair[which]] + tok_word[token] - word_begin[self.r[pair[which]]], 0)
            got = np.zeros(len(token), dtype=bool)
            got[inside] = (union[spot[inside]] >> tok_bit[token[inside]].astype(np.uint64)) & _ONE
            if long:
                first = np.searchsorted(which, np.arange(j - i))
                for k in np.flatnonzero(np.isin(self.r[pair], list(long)) & (m[pair] > 0)).tolist():
                    base, p = int(self.begin[self.r[pair[k]]]), self.p[pair[k]]
                    for s in long[int(self.r[pair[k]])]:
                        found = self._long_union(p, int(seg[s]), int(seg_size[s]), seg, seg_size, seg_begin)
                        got[first[k] + int(seg[s]) - base + np.array(found, dtype=np.int64)] = True
            have = np.bincount((off[which] + self.local[token])[got], minlength=off[-1])
            which, token = _spans(self.begin[self.p[pair]], m[pair])
            own = np.bincount(off[which] + self.local[token], minlength=off[-1])
            total = np.concatenate(([0], np.cumsum(np.minimum(have, own))))
            out[i:j] = total[off[1:]] - total[off[:-1]]
        return out

    def _long_union(self, p: int, a: int, size: int, seg, seg_size, seg_begin) -> list[int]:
        """Positions of one long target sentence that an LCS with some sentence of the prediction text ``p`` matches."""
        target = self._list(a, a + size)
        masks, found = seqstats._masks(target), set()
        own = set(self._list(self.begin[p], self.begin[p + 1]))
        reachable = sum(1 for t in target if t in own)
        for s in range(seg_begin[p], seg_begin[p + 1]):
            if len(found) == reachable:
                break
            sent = self._list(seg[s], seg[s] + seg_size[s])
            if not masks.keys().isdisjoint(sent):
                found.update(seqstats.lcs_target_positions(sent, target, masks))
        return sorted(found)

    def _union(self, pw_pair, pw_word, union, seg, seg_size, seg_begin, word_text, full, place) -> None:
        """Ors into ``union`` what each sentence of the pair's prediction matches in the word of the reference."""
        p = self.p[pw_pair]
        lane, sent = _spans(seg_begin[p], np.diff(seg_begin)[p])
        order = np.argsort(-seg_size[sent], kind="stable")
        lane, sent = lane[order], sent[order]
        size = seg_size[sent]
        steps = int(size[FEW - 1]) if len(size) >= FEW else 0
        lone = int(np.searchsorted(-size, -steps, "left"))
        tok_word, tok_bit, widest = place
        words, back = np.unique(pw_word, return_inverse=True)
        _, token = _spans(self.begin[word_text[words]], self.size[word_text[words]])
        number = np.full(len(full) + 1, -1, dtype=np.int64)  # the last one: no word
        number[words] = np.arange(len(words))
        token = np.unique(token[number[tok_word[token]] >= 0])
        table, off = self._table(number[tok_word[token]], tok_bit[token], token, word_text[words])
        off, mask = off[back], full[pw_word]
        near, level = [mask & (mask >> _ONE)], 1
        while 2 * level < widest:
            near.append(near[-1] & (near[-1] >> np.uint64(level)))
            level *= 2
        for x, s in zip(lane[:lone].tolist(), sent[:lone].tolist()):
            hits = table[off[x] + self.local[seg[s]:seg[s] + seg_size[s]]]
            union[x] |= np.uint64(_matched(hits[_steps(hits != 0)].tolist(), int(mask[x]), [int(k[x]) for k in near]))
        lane, sent, size = lane[lone:], sent[lone:], size[lone:]
        if not len(lane):
            return
        off, mask, start, near = off[lane], mask[lane], seg[sent], [k[lane] for k in near]
        active = np.searchsorted(-size, -np.arange(steps), "left")
        row, rows, seen = mask.copy(), [], []
        for i in range(steps):
            a = active[i]
            hit = table[off[:a] + self.local[start[:a] + i]]
            v = row[:a]
            u = v & hit
            v = ((v + u) | (v ^ u)) & mask[:a]
            row[:a] = v
            rows.append(v)
            seen.append(hit)
        below, out = mask.copy(), np.zeros(len(mask), dtype=np.uint64)
        for i in range(steps - 1, -1, -1):
            a = active[i]
            # of the bits below the current one: the highest that matches or where the row steps, and all below it
            x = (~rows[i] | seen[i]) & below[:a]
            for k, keep in enumerate(near):
                x |= (x >> np.uint64(1 << k)) & keep[:a]
            top = x & ~((x >> _ONE) & near[0][:a])
            top &= seen[i]
            out[:a] |= top
            below[:a] = x ^ top
        np.bitwise_or.at(union, lane, out)


# ---- all statistics of a batch ----------------------------------------------------

def score(pred: Sequence[str | None], refs: Sequence[Sequence[str | None] | None], bleu: int = 0, chrf: bool = False,
          keys: Sequence[str] = ()) -> dict[str, list]:
    """Per row, as asked for: ``clip``, ``c``, ``rl`` as ``ngrambatch.bleu_rows`` (orders 1..``bleu``), ``match``, ``hyp``,
    ``ref`` as ``ngrambatch.chrf_rows``, and ``pl`` and, a value each reference, ``tl`` and the hits of the ROUGE ``keys``."""
    pred = [p or "" for p in pred]
    refs = [[r or "" for r in rs] if rs is not None else [] for rs in refs]
    out: dict[str, list] = {}
    for i, j in chunks(ngrambatch._sizes(pred, refs), CHUNK_CHARS):
        few = [k for k in range(i, j) if len(refs[k]) <= SIDE]
        got = _score([pred[k] for k in few], [refs[k] for k in few], bleu, chrf, keys)
        if len(few) < j - i:
            many = [k for k in range(i, j) if len(refs[k]) > SIDE]
            rest = _plain([pred[k] for k in many], [refs[k] for k in many], bleu, chrf, keys)
            place = {k: x for x, k in enumerate(few + many)}
            got = {n: [(v + rest[n])[place[k]] for k in range(i, j)] for n, v in got.items()}
        for n, v in got.items():
            out.setdefault(n, []).extend(v)
    return out


def _score(pred, refs, bleu: int, chrf: bool, keys) -> dict[str, list]:
    groups = Groups(pred, refs)
    g, k = groups.row.T
    out: dict[str, list] = {}
    words = ws_tokens(groups.texts) if bleu or chrf else None
    if bleu:
        clip = match_windows(words.ids, words.owner, groups, bleu, best=True)
        if clip is None:
            out |= _plain(pred, refs, bleu, False, ())
        else:
            size = groups.lengths(words.owner)
            out |= {"clip": clip[:, g, k].T.tolist(), "c": size[groups.pred].tolist(), "rl": _by_row(groups, size)}
    if chrf:
        out |= _chrf(pred, refs, groups, chrf_words(words))
    if keys:
        tokens, sentence = rouge_tokens(groups.texts)
        size = groups.lengths(tokens.owner)
        out |= {"pl": size[groups.pred].tolist(), "tl": _by_row(groups, size)}
        row, p, r = groups.pairs()
        orders = 2 if "rouge2" in keys else 1 if "rouge1" in keys else 0
        if orders:
            hits = match_windows(tokens.ids, tokens.owner, groups, orders)
            if hits is None:
                out |= _plain(pred, refs, 0, False, [x for x in keys if x in ("rouge1", "rouge2")])
            else:
                at = g[row], k[row], groups.slot[r] - SIDE
                out |= {f"rouge{n}": _split(groups, hits[n - 1][at]) for n in range(1, orders + 1) if f"rouge{n}" in keys}
        if "rougeL" in keys or "rougeLsum" in keys:
            lcs = Lcs(tokens, sentence, groups)
            if "rougeL" in keys:
                out["rougeL"] = _split(groups, lcs.lengths())
            if "rougeLsum" in keys:
                out["rougeLsum"] = _split(groups, lcs.union_hits())
    return out


def _split(groups: Groups, values: np.ndarray) -> list[list[int]]:
    """The values of each row's pairs."""
    values, ends = values.tolist(), np.cumsum(groups.n_refs).tolist()
    return [values[a:z] for a, z in zip([0, *ends], ends)]


def _by_row(groups: Groups, size: np.ndarray) -> list[list[int]]:
    return _split(groups, size[groups.pairs()[2]])


def _chrf(pred, refs, groups: Groups, words: Tokens) -> dict[str, list]:
    data = np.frombuffer("".join(groups.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(groups.texts)), [len(t) for t in groups.texts])
    inside = data != ord(" ")
    data, owner = data[inside], owner[inside]
    known = np.zeros(int(data.max(initial=0)) + 1, dtype=bool)
    known[data] = True
    ids = (np.cumsum(known) - 1)[data]
    match = [match_windows(ids, owner, groups, CHAR_ORDER), match_windows(words.ids, words.owner, groups, WORD_ORDER)]
    if any(m is None for m in match):
        return _plain(pred, refs, 0, True, ())
    size = np.concatenate([np.maximum(groups.lengths(own)[:, None] - np.arange(n), 0)
                           for own, n in ((owner, CHAR_ORDER), (words.owner, WORD_ORDER))], axis=1)
    row, p, r = groups.pairs()
    hits = np.concatenate(match)[:, groups.row[row, 0], groups.row[row, 1], groups.slot[r] - SIDE].T
    f = np.zeros((len(pred), SIDE))
    at = groups.slot[r] - SIDE
    f[row, at] = ngrambatch.fscores(hits, size[p], size[r])
    best = f.argmax(axis=1)  # the first of equal ones
    some = f[np.arange(len(f)), best] > 0
    pair = np.minimum(np.cumsum(groups.n_refs) - groups.n_refs + best, max(0, len(row) - 1))
    if not len(row):
        none = np.zeros((len(pred), size.shape[1]), dtype=np.int64)
        return {"match": none.tolist(), "hyp": size[groups.pred].tolist(), "ref": none.tolist()}
    keep = some[:, None]
    return {"match": np.where(keep, hits[pair], 0).tolist(), "hyp": size[groups.pred].tolist(),
            "ref": np.where(keep, size[r][pair], 0).tolist()}


def _plain(pred, refs, bleu: int, chrf: bool, keys) -> dict[str, list]:
    """``score`` text by text or by windows of any size."""
    out: dict[str, list] = {}
    if bleu:
        out |= dict(zip(("clip", "c", "rl"), map(list, zip(*ngrambatch.bleu_rows(pred, refs, bleu)))))
    if chrf:
        out |= dict(zip(("match", "hyp", "ref"), map(list, zip(*ngrambatch.chrf_rows(pred, refs)))))
    if keys:
        split = seqstats.rouge_sentences
        sents = [(split(p), [split(r) for r in rs]) for p, rs in zip(pred, refs)]
        hits = [[seqstats.lcs_hits(p, r, keys) for r in rs] for p, rs in sents]
        out |= {"pl": [sum(map(len, p)) for p, _ in sents], "tl": [[h["tl"] for h in hs] for hs in hits]}
        out |= {n: [[h[n] for h in hs] for hs in hits] for n in ("rougeL", "rougeLsum") if n in keys}
        orders = 2 if "rouge2" in keys else 1 if "rouge1" in keys else 0
        ends = np.cumsum([len(rs) for rs in refs]).tolist()
        flat = ngrambatch.rouge_n_pairs([p for p, rs in zip(pred, refs) for _ in rs], [r for rs in refs for r in rs], orders) \
            if orders else []
        for n, m in enumerate(flat, start=1):
            if f"rouge{n}" in keys:
                out[f"rouge{n}"] = [m[a:z].tolist() for a, z in zip([0, *ends], ends)]
    return out
