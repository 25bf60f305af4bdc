"""Operator 9: personal data by patterns plus a skip-chain conditional random field (CRF).

Base spans (email, ip, card, phone) come from exact linear-time matchers. The CRF then labels the other tokens that
hold a digit or ``@``: its nodes are those tokens, with a unary potential from the token's shape, a chain potential to
the next node if they are neighbours in the text, and a skip potential between successive occurrences of the same or a
similar token (of ``MIN_KEY`` characters or more, since shorter ones recur by chance; equal without outer punctuation and
case; an email also meets its own name part) anywhere in the document. When a document is labelled, tokens without a digit
that equal the name part of one of its emails are nodes too if that part holds a dot, underscore, per cent, plus or hyphen
(``jane.smith``, but not ``info``, which is an ordinary word). Tokens in base spans are clamped to their kind, tokens of a rejected match (failed checksum or range) to
"other". Loopy sum-product messages with damping run until they settle; an unclamped token becomes a span if its belief
reaches ``min_belief`` and the skip chain connects it to a base span of that kind, so labels are consistent across
a document and a document without base spans gains none.

Training is piecewise: each potential is the smoothed log frequency ratio of its piece, counted over the base labels of
all documents (shapes hashed to ``SHAPES`` buckets, so the model has a fixed size). Name parts without a digit take no
part in it: no base pattern says whether such a token is personal.

Scale: two passes over the texts without a shuffle of text; the first shuffles at most a few thousand counts a task.
Skip edges link an occurrence to the next one only, so a token repeated k times makes k - 1 edges. Defined cases: null
text counts as empty (no spans); repeated rows are independent; empty tables give empty tables; other input columns are
ignored by ``find_pii`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SHAPES = 4096
MIN_KEY = 5
_HINT = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and the look-behind only stop retries that cannot succeed; matches equal the plain patterns'.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_JOINED = re.compile(r"[._%+-]")
_TOKEN = re.compile(r"\S+")
_OUTER = ".,;:!?()[]{}<>\"'"

Span = tuple[int, int, int]  # (kind index in KINDS, start, end), in code points


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """(accepted spans by kind then start, rejected match ranges)."""
    if not text or not _HINT.search(text):
        return [], []
    found, bad = _emails(text), []
    if not _DIGIT.search(text):
        return found, bad
    for m in _IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
        found.append((1, *m.span())) if good else bad.append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
        elif len(digits) >= 13:
            bad.append(m.span())
    for m in _PHONE.finditer(text) if "+" in text else ():
        good = 9 <= len(_DIGIT.findall(m[0])) <= 15
        found.append((3, *m.span())) if good else bad.append(m.span())
    return found, bad


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def shape_bucket(token: str) -> int:
    """Runs of digits and letters with their length (up to 20), other characters as they are, hashed."""
    parts = re.findall(r"[0-9]{1,20}|[^\W\d_]{1,20}|.", token, re.S)
    shape = "".join(f"9{len(p)}" if p[0].isdigit() else f"a{min(len(p), 4)}" if p[0].isalpha() else p for p in parts)
    return zlib.crc32(shape.encode()) % SHAPES


def name_parts(text: str, spans: list[Span]) -> frozenset[str]:
    """Lower-case name parts of the emails in ``spans`` that are no ordinary words."""
    local = {text[a:text.index("@", a)].strip(_OUTER).lower() for k, a, _ in spans if KINDS[k] == "email"}
    return frozenset(x for x in local if len(x) >= MIN_KEY and _JOINED.search(x))


class Graph:
    """Nodes, labels and edges of one document. ``names``: lower-case tokens that are nodes without holding a digit."""

    def __init__(self, text: str, spans: list[Span], bad: list[tuple[int, int]], names: frozenset[str] = frozenset()):
        self.at: list[tuple[int, int]] = []
        self.label: list[int] = []  # clamped label, -1 where free
        self.shape: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        marks = sorted([(a, b, k + 1) for k, a, b in spans] + [(a, b, 0) for a, b in bad])
        last: dict[str, int] = {}
        before, low, reach = -2, 0, 0
        for t, m in enumerate(_TOKEN.finditer(text)):
            a, b = m.span()
            while low < len(marks) and marks[low][1] <= a and marks[low][0] <= a:
                low += 1
            hits = []
            for x in marks[low:]:
                if x[0] >= b:
                    break
                if x[1] > a:
                    hits.append(x)
            token = m[0]
            bare = token.strip(_OUTER)
            if not hits and not _HINT.search(token) and bare.lower() not in names:
                continue
            a += len(token) - len(token.lstrip(_OUTER)) if bare else 0
            node = len(self.at)
            self.at.append((a, a + len(bare)) if bare else m.span())
            self.label.append(max(x[2] for x in hits) if hits else -1)
            self.shape.append(shape_bucket(bare or token))
            if before == t - 1:
                self.chain.append((node - 1, node))
            before = t
            key = bare.lower()
            for k in {key, key.split("@")[0]}:
                if len(k) >= MIN_KEY:
                    if k in last and last[k] != node:
                        self.skip.append((last[k], node))
                    last[k] = node


def count_pieces(docs: DataFrame) -> DataFrame:
    """(piece, a, b, n): label counts of shapes, of neighbours and of skip pairs over the base labels of all docs."""

    def run(batches):
        for batch in batches:
            unary = np.zeros((SHAPES, len(LABELS)), np.int64)
            pair = np.zeros((2, len(LABELS), len(LABELS)), np.int64)
            for text in batch.column(0).to_pylist():
                if not text or not _HINT.search(text):
                    continue
                g = Graph(text, *base_spans(text))
                label = [max(x, 0) for x in g.label]
                for s, x in zip(g.shape, label):
                    unary[s, x] += 1
                for kind, edges in enumerate((g.chain, g.skip)):
                    for i, j in edges:
                        pair[kind, label[i], label[j]] += 1
            rows = [(0, *np.nonzero(unary), unary[np.nonzero(unary)])]
            rows += [(k + 1, *np.nonzero(pair[k]), pair[k][np.nonzero(pair[k])]) for k in (0, 1)]
            for piece, a, b, n in rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), piece, np.int32)), pa.array(a.astype(np.int32)),
                     pa.array(b.astype(np.int32)), pa.array(n)], names=["piece", "a", "b", "n"])

    return (docs.select("text").mapInArrow(run, "piece int, a int, b int, n long")
            .groupBy("piece", "a", "b").agg(F.sum("n").alias("n")))


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Piecewise-trained log potentials: ``unary`` (shape, label), ``chain`` and ``skip`` (label, label)."""
    unary = np.full((SHAPES, len(LABELS)), 0.1)
    pairs = np.full((2, len(LABELS), len(LABELS)), 0.1)
    pairs += np.eye(len(LABELS)) * 0.9  # a prior count for equal labels: pieces may be rare
    for r in count_pieces(docs).collect():  # at most SHAPES * 5 + 50 rows
        if r["piece"] == 0:
            unary[r["a"], r["b"]] += r["n"]
        else:
            pairs[r["piece"] - 1, r["a"], r["b"]] += r["n"]
            pairs[r["piece"] - 1, r["b"], r["a"]] += r["n"]
    share = unary.sum(axis=0) / unary.sum()
    out = {"unary": np.log(unary / unary.sum(axis=1, keepdims=True))}
    for k, name in enumerate(("chain", "skip")):
        p = pairs[k] / pairs[k].sum()
        side = np.sqrt(p.sum(axis=1) * share)
        out[name] = np.clip(np.log(p / np.outer(side, side)), -6, 6)
    return out


def propagate(g: Graph, model: dict[str, np.ndarray], rounds: int = 20, damping: float = 0.3) -> np.ndarray:
    """Beliefs (node, label) by loopy sum-product message passing."""
    n, L = len(g.at), len(LABELS)
    own = model["unary"][g.shape].copy()
    for i, x in enumerate(g.label):
        if x >= 0:
            own[i] = -50.0
            own[i, x] = 0.0
    edges = [(i, j, model["chain"]) for i, j in g.chain] + [(i, j, model["skip"]) for i, j in g.skip]
    src = np.array([i for i, j, _ in edges] + [j for i, j, _ in edges], dtype=np.int64)
    dst = np.array([j for i, j, _ in edges] + [i for i, j, _ in edges], dtype=np.int64)
    pot = np.array([p for _, _, p in edges] + [p.T for _, _, p in edges]).reshape(-1, L, L)
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    msg = np.zeros((len(src), L))
    for _ in range(rounds if len(src) else 0):
        total = own.copy()
        np.add.at(total, dst, msg)
        out = total[src] - msg[back]
        new = np.logaddexp.reduce(pot + out[:, :, None], axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        step = damping * msg + (1 - damping) * new
        settled = np.abs(step - msg).max() < 1e-6
        msg = step
        if settled:
            break
    total = own
    np.add.at(total, dst, msg)
    return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))


def document_spans(text: str, model: dict[str, np.ndarray], min_belief: float = 0.8) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind and start."""
    base, bad = base_spans(text)
    if not base:
        return base, base
    g = Graph(text, base, bad, name_parts(text, base))
    if -1 not in g.label or not g.skip:
        return base, base
    tied = list(range(len(g.at)))  # union-find over the skip edges

    def root(i: int) -> int:
        while tied[i] != i:
            tied[i] = tied[tied[i]]
            i = tied[i]
        return i

    for i, j in g.skip:
        tied[root(i)] = root(j)
    known: dict[int, set[int]] = {}
    for i, x in enumerate(g.label):
        if x > 0:
            known.setdefault(root(i), set()).add(x)
    if not any(x < 0 and root(i) in known for i, x in enumerate(g.label)):
        return base, base
    belief = propagate(g, model)
    spans = list(base)
    for i, x in enumerate(g.label):
        best = int(belief[i].argmax())
        if x < 0 and best and belief[i, best] >= min_belief and best in known.get(root(i), ()):
            spans.append((best - 1, *g.at[i]))
    return base, sorted(spans)


PII_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, spans = document_spans(text or "", model)
                n = [0, 0, 0, 0]
                for k, _, _ in base:
                    n[k] += 1
                out.append((*n, hashlib.sha256(render(base).encode()).hexdigest(), render(spans)))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PII_SCHEMA)


def mask(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are replaced once, by the first."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` (all columns) with the spans of ``text`` masked; null texts stay null. ``n_chars`` follows the text if
    the table has it."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            out = [t and mask(t, document_spans(t, model)[1]) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
