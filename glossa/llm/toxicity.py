"""Operator 10: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A text is a bag of units: its white-space words (ASCII lower-cased; a word over ``WIDTH`` bytes is several overlapping
windows; a run of three or more one-letter words is one unit, so spaced-out words are seen). The kernel of two units
counts their common subsequences of three characters, each occurrence weighted by ``DECAY`` per skipped character, with
at most two skipped characters in all; digits and punctuation are skipped only, never part of one. So gapped and inserted-character spellings stay close to the plain word:
``K(x, y) = sum_u phi_u(x) phi_u(y) / (N(x) N(y))`` with ``N`` the norm of ``phi``.

Training (multiple-instance SVM): a bounded sample of labelled texts, in which a toxic text is a bag with at least one
toxic unit. Witness units of the toxic bags (first: units in so many contexts of toxic texts that their absence from
the clean ones is no chance) stand against units of clean texts; landmarks are drawn from both, ``z(x) = K_mm^(-1/2) k(x, landmarks)`` are the Nystroem
features, and a linear SVM is fitted on them; then witnesses and hard negatives are chosen anew by the fitted margin.
The machine is stored in its primal form: ``f(x) = w . phi(x) / N(x) + b`` with
``w = sum_l beta_l phi(l) / N(l)``, the same function as the sum over landmarks, at the cost of a table look-up.

A text's score is a logistic function of its largest unit margin, calibrated by cross-fitting.

Scale: the sample is bounded (``TOXIC_DOCS`` and ``CLEAN_DOCS`` whole texts, ``SAMPLE_CHARS`` characters of each label),
and a fit draws from its distinct units: at most ``WITNESSES`` toxic ones, ``FIRST_CLEAN`` clean ones to begin with, then
the ``HARD_CLEAN`` of the largest margin and ``MORE_CLEAN`` others. These bounds only concern the fit;
scoring is one pass over whole texts without a shuffle. Labels, lang, source and doc_id never enter a score.

Defined cases: null or empty texts (no unit) get the score of margin ``NO_UNIT``, the lowest; without toxic or without
clean training texts every score is 0; repeated rows are scored alike; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.components import store
from glossa.llm.textkit import IS_WORD, LOWER, U64, mix64, row_slices, text_buffer

WIDTH = 24
DECAY = 0.7
PATTERNS = ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0))
LANDMARKS = 192
TOXIC_DOCS = 1500
CLEAN_DOCS = 3000
SAMPLE_CHARS = 1 << 24  # of each label
FIRST_CLEAN, WITNESSES, HARD_CLEAN, MORE_CLEAN = 6000, 3000, 3000, 4000
NO_UNIT = -4.0
SURE = 5.0
THRESHOLD = 0.7
_CLASS = np.zeros(256, dtype=np.int64)  # letters, bytes of other scripts; 0: padding and what only counts as a gap
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 37
_FEATURES = 64**3
_UNIT_SLICE = 1 << 22


def unit_matrix(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(units as a (n, WIDTH) uint8 matrix padded with 0, row number of each unit) of the texts ``offs``."""
    s, e = int(offs[0]), int(offs[-1])
    if e == s:
        return np.zeros((0, WIDTH), np.uint8), np.empty(0, np.int64)
    b = LOWER[buf[s:e]]
    rel = offs - s
    word = IS_WORD[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[rel] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(rel, start, side="right") - 1
    size = end - start
    extra = np.maximum(0, -(-(size - WIDTH) // (WIDTH // 2)))
    if extra.any():
        k = np.repeat(np.arange(len(start)), extra + 1)
        shift = np.arange(len(k)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
        begin = start[k] + shift * (WIDTH // 2)
        stop, unit_row = np.minimum(begin + WIDTH, end[k]), row[k]
    else:
        begin, stop, unit_row = start, end, row
    padded = np.concatenate((b, np.zeros(WIDTH, np.uint8)))
    units = padded[begin[:, None] + np.arange(WIDTH)]
    units[np.arange(WIDTH) >= (stop - begin)[:, None]] = 0
    single = size == 1
    if single.any():
        cut = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
        more, more_row = [], []
        for x, y in cut.reshape(-1, 2):
            for lo in range(x, y, WIDTH // 2):
                run = [i for i in range(lo, min(y, lo + WIDTH)) if row[i] == row[lo]]
                if len(run) >= 3:
                    u = np.zeros(WIDTH, np.uint8)
                    u[:len(run)] = b[start[run]]
                    more.append(u)
                    more_row.append(row[lo])
        if more:
            units, unit_row = np.concatenate((units, more)), np.concatenate((unit_row, more_row))
    return units, unit_row


def unit_keys(units: np.ndarray) -> np.ndarray:
    parts = np.ascontiguousarray(units).view(np.uint64)
    h = np.zeros(len(units), dtype=np.uint64)
    for j in range(parts.shape[1]):
        h = mix64(h * U64(0xE7037ED1A0B428DB) + parts[:, j])
    return h


_WEIGHT = np.array([1.0, DECAY, DECAY**2, 0.0], dtype=np.float32)  # by skipped characters; 3: not an occurrence


def features(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, weights, norms): a column per occurrence; the weight is 0 where a pattern meets no letter."""
    c = _CLASS[units].astype(np.int32)
    keys = []  # feature id and skipped characters in one integer
    for g, h in PATTERNS:
        span = g + h + 3
        x, y, z = c[:, :WIDTH - span + 1], c[:, g + 1:g + 1 + WIDTH - span + 1], c[:, span - 1:]
        keys.append(((x * 64 + y) * 64 + z) * 4 + np.where((x > 0) & (y > 0) & (z > 0), g + h, 3))
    keys = np.concatenate(keys, axis=1)
    n, m = keys.shape
    if not n:
        return keys, keys.astype(np.float32), np.zeros(0, np.float32)
    # phi sums the occurrences of a feature: equal ids are neighbours in a sorted row
    ordered = np.sort(keys, axis=1)
    edge = np.ones((n, m), dtype=bool)
    edge[:, 1:] = ordered[:, 1:] >> 2 != ordered[:, :-1] >> 2
    at = np.flatnonzero(edge)
    phi = np.add.reduceat(_WEIGHT[ordered & 3].ravel(), at)
    norm = np.sqrt(np.bincount(at // m, weights=phi * phi, minlength=n))
    return keys >> 2, _WEIGHT[keys & 3], norm.astype(np.float32)


@dataclass
class Machine:
    """Primal form: ``table`` has w by feature id; ``slope`` and ``offset`` calibrate a margin."""

    table: np.ndarray
    bias: float
    slope: float = 0.0
    offset: float = -50.0

    def margins(self, units: np.ndarray) -> np.ndarray:
        out = np.empty(len(units), dtype=np.float32)
        for i in range(0, len(units), 8192):
            ids, w, norm = features(units[i:i + 8192])
            out[i:i + 8192] = np.einsum("ij,ij->i", self.table[ids], w) / np.maximum(norm, 1e-6)
        return out + np.float32(self.bias)

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.clip(margin, -4, 4) + self.offset, -50, 50)))


class Landmarks:
    """phi(l) / N(l) of the landmark units, over the features that they use."""

    def __init__(self, units: np.ndarray):
        ids, w, norm = features(units)
        w = w / np.maximum(norm, 1e-6)[:, None]
        self.used = np.unique(ids[w > 0])
        self.phi = np.zeros((len(self.used) + 1, len(units)), dtype=np.float32)
        row, col = np.nonzero(w > 0)
        np.add.at(self.phi, (np.searchsorted(self.used, ids[row, col]) + 1, row), w[row, col])
        self.place = np.zeros(_FEATURES, dtype=np.int32)
        self.place[self.used] = np.arange(1, len(self.used) + 1)

    def kernel(self, units: np.ndarray) -> np.ndarray:
        """K(unit, landmark)."""
        out = np.empty((len(units), self.phi.shape[1]), dtype=np.float32)
        for i in range(0, len(units), 1024):
            ids, w, norm = features(units[i:i + 1024])
            at = self.place[ids] * (w > 0)
            for r in range(len(at)):
                hit = np.flatnonzero(at[r])
                out[i + r] = w[r, hit] @ self.phi[at[r, hit]] / max(norm[r], 1e-6)
        return out

    def gram(self) -> np.ndarray:
        return self.phi.T @ self.phi


def pick_landmarks(units: np.ndarray, most: int) -> np.ndarray:
    """Pivoted incomplete Cholesky: each landmark is the unit that the earlier ones represent worst."""
    residual = np.ones(len(units))
    factor = np.zeros((len(units), 0))
    chosen: list[int] = []
    while len(chosen) < min(most, len(units)) and residual.max() > 0.05:
        p = int(residual.argmax())
        column = Landmarks(units[p:p + 1]).kernel(units)[:, 0].astype(np.float64)
        column = (column - factor @ factor[p]) / np.sqrt(residual[p])
        factor = np.hstack([factor, column[:, None]])
        residual = np.maximum(residual - column**2, 0)
        residual[p] = 0
        chosen.append(p)
    return units[chosen]


def _linear_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rng, epochs: int = 20) -> tuple[np.ndarray, float]:
    """Linear SVM (hinge loss, cost per row) by dual coordinate descent."""
    z = np.hstack([z, np.ones((len(z), 1), np.float32)]).astype(np.float64)
    u, alpha, square = np.zeros(z.shape[1]), np.zeros(len(z)), (z * z).sum(axis=1)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(z)):
            new = min(max(alpha[i] + (1.0 - y[i] * (z[i] @ u)) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                u += (new - alpha[i]) * y[i] * z[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return u[:-1], float(u[-1])


def fit_units(pos: np.ndarray, neg: np.ndarray, rng) -> Machine:
    """One Nystroem SVM on units."""
    marks = Landmarks(np.concatenate((pick_landmarks(pos, LANDMARKS), neg[:LANDMARKS // 2])))
    value, vector = np.linalg.eigh(marks.gram().astype(np.float64))
    keep = value > 1e-3 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = marks.kernel(np.concatenate((pos, neg))) @ root.astype(np.float32)
    y = np.concatenate((np.ones(len(pos)), -np.ones(len(neg))))
    u, bias = _linear_svm(z, y, np.where(y > 0, 100.0, 1.0), rng)
    table = np.zeros(_FEATURES, dtype=np.float32)
    table[marks.used] = marks.phi[1:] @ (root @ u)
    return Machine(table, bias)


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = text_buffer(pa.array(texts, pa.string()))
    parts = [(u, r + i) for i, j in row_slices(offs, _UNIT_SLICE) for u, r in [unit_matrix(buf, offs[i:j + 1])]]
    if not parts:
        return np.zeros((0, WIDTH), np.uint8), np.empty(0, np.int64)
    return np.concatenate([u for u, _ in parts]), np.concatenate([r for _, r in parts])


def _contexts(units: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct unit keys, number of distinct preceding units): copies of a text add no context."""
    key = unit_keys(units)
    before = np.concatenate(([U64(0)], key[:-1]))
    before[np.flatnonzero(np.diff(np.concatenate(([-1], rows))))] = U64(0)
    pair = np.unique(np.stack((key, before), axis=1), axis=0)
    return np.unique(pair[:, 0], return_counts=True)


def fit_texts(toxic: list[str], clean: list[str], rounds: int, seed: int) -> Machine:
    """The uncalibrated machine of some texts."""
    rng = np.random.default_rng(seed)
    never = Machine(np.zeros(_FEATURES, np.float32), 0.0)
    t_units, t_rows = _bags(toxic)
    c_units, _ = _bags(clean)
    if not len(t_units) or not len(c_units):
        return never
    t_keys, t_ctx = _contexts(t_units, t_rows)
    t_first = np.unique(unit_keys(t_units), return_index=True)[1]
    c_keys, c_first = np.unique(unit_keys(c_units), return_index=True)
    fresh = ~np.isin(t_keys, c_keys, assume_unique=True)
    # A unit of clean texts would occur in these clean texts too, but for a chance of exp(-SURE),
    # shared by all units tried.
    sure = SURE + np.log(max(1, fresh.sum()))
    least = max(3, int(np.ceil(sure * len(t_units) / len(c_units))))
    contexts = np.where(fresh, t_ctx, 0)
    chosen = np.flatnonzero(contexts >= max(1, min(least, contexts.max())))
    if not len(chosen):
        return never
    t_all, neg_all = t_units[t_first], c_units[c_first]
    neg = neg_all[rng.permutation(len(neg_all))[:FIRST_CLEAN]]
    machine = never
    for step in range(rounds):
        machine = fit_units(t_all[chosen[rng.permutation(len(chosen))[:WITNESSES]]], neg, rng)
        if step == rounds - 1:
            break
        clean_margin, margin = machine.margins(neg_all), machine.margins(t_all)
        bar = max(0.0, float(np.quantile(clean_margin, 1 - 1e-4)))
        chosen = np.union1d(chosen, np.flatnonzero((contexts >= 2) & (margin > bar)))
        hard = neg_all[np.argsort(-clean_margin, kind="stable")[:HARD_CLEAN]]
        neg = np.concatenate((hard, neg_all[rng.permutation(len(neg_all))[:MORE_CLEAN]]))
    return machine


def fit(toxic: list[str], clean: list[str], rounds: int = 2, seed: int = 11, folds: int = 6) -> Machine:
    """Fit on all texts; margins of texts left out in ``folds`` more fits calibrate the score."""
    if not toxic or not clean:
        return Machine(np.zeros(_FEATURES, np.float32), 0.0)
    margin, label = [], []
    for k in range(folds):
        part = fit_texts([t for i, t in enumerate(toxic) if i % folds != k],
                         [t for i, t in enumerate(clean) if i % folds != k], rounds, seed + k)
        for y, texts in ((1.0, toxic[k::folds]), (0.0, clean[k::folds])):
            margin.append(np.clip(text_margins(part, texts), -4, 4))
            label.append(np.full(len(texts), y))
    machine = fit_texts(toxic, clean, rounds, seed)
    machine.slope, machine.offset = _platt(np.concatenate(margin), np.concatenate(label))
    return machine


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps with smoothed targets and a small ridge."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack((margin, np.ones(len(margin))), axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        grad = x.T @ (p - target) + 0.01 * a
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(a[0]), float(a[1])


def array_margins(machine: Machine, texts: pa.Array) -> np.ndarray:
    """Largest unit margin of every text; distinct units are scored once a slice."""
    buf, offs = text_buffer(texts)
    out = np.full(len(texts), NO_UNIT)
    for i, j in row_slices(offs, _UNIT_SLICE):
        units, rows = unit_matrix(buf, offs[i:j + 1])
        if len(units):
            _, first, inv = np.unique(unit_keys(units), return_index=True, return_inverse=True)
            margin = machine.margins(units[first])[inv]
            top = np.full(j - i, NO_UNIT)
            np.maximum.at(top, rows, margin)
            out[i:j] = top
    return out


def text_margins(machine: Machine, texts: list[str]) -> np.ndarray:
    return array_margins(machine, pa.array(texts, pa.string()))


def labelled_sample(docs: DataFrame, labels: DataFrame, toxic_docs: int, clean_docs: int) -> DataFrame:
    """(text, toxic) of at most about ``toxic_docs`` + ``clean_docs`` labelled whole texts, drawn by a hash of doc_id; of
    each label texts are taken, by a hash of the text, until they hold ``SAMPLE_CHARS`` characters. The distinct ids of
    the sample are broadcast (bounded); equal texts count once."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, toxic_docs / max(1, size.get(1, 0)))) \
        .otherwise(min(1.0, clean_docs / max(1, size.get(0, 0))))
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = known.filter(u < share)
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    drawn = store(texts.join(F.broadcast(ids), "doc_id").select("text", "toxic").distinct(), "toxicity-sample")

    place = F.xxhash64("text")
    sizes = drawn.select("toxic", place.alias("place"), F.length("text").cast("long").alias("chars")).toPandas() \
        .sort_values(["toxic", "place"])
    taken = sizes[sizes.groupby("toxic")["chars"].cumsum() - sizes["chars"] < SAMPLE_CHARS]
    keep = F.lit(False)
    for toxic, last in taken.groupby("toxic")["place"].max().items():
        keep = keep | ((F.col("toxic") == int(toxic)) & (place <= int(last)))
    return drawn.filter(keep)


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Machine:
    """Fit on the bounded sample, which comes to the driver."""
    rows = labelled_sample(docs, labels, toxic_docs, clean_docs).toPandas()
    rows = rows.assign(h=[zlib.crc32(t.encode()) for t in rows["text"]]).sort_values(["h", "text"])
    return fit(list(rows.loc[rows["toxic"] == 1, "text"]), list(rows.loc[rows["toxic"] == 0, "text"]))


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, machine: Machine, held: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Toxicity of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            p = shared.value.score(array_margins(shared.value, batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, SCORE_SCHEMA)
