"""Greedy-match similarity of a system's own texts to each reference (F7 in F11 and D6).

The re-aimed encoder is random indexing: every token has a fixed sparse index vector (one coordinate of ``WIDTH`` and a
sign, both read from the token's md5), and a token's vector is the sum of the index vectors of the tokens at most
``reach`` places away, itself included, over all texts. All sums are integers, so the vectors don't depend on order.

Vectors are one counting job: slices of texts are counted by array operations, and one row of sums per token and slice is
merged on the map side, so a token is shuffled once a task, however often it occurs. Nothing is broadcast: texts meet
the vectors through a dictionary per chunk of rows that holds each distinct token once, so a token that holds a third of
all words costs one row a chunk. Within a pair only distinct tokens are compared, ``BLOCK`` at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import pairbatch
from glossa.functions.ngrambatch import chunks
from glossa.functions.text import tokens
from glossa.session import stored

WIDTH = 16
REACH = 2
CHUNK_ROWS = 16384  # rows that share a dictionary, unless their texts are longer than
CHUNK_CHARS = 1 << 23  # so many characters in all
SLICE_CHARS = 1 << 22  # characters whose tokens are counted together
BLOCK = 512  # distinct prediction tokens compared with a reference at a time
CELLS = 1 << 17  # cosines of pairs of like sizes that are held together: they stay in a core's cache


def _words(text: Column) -> Column:
    return F.coalesce(tokens(text), F.array().cast("array<string>"))


def index_code(token: Column) -> Column:
    """2 * coordinate + (1 if the sign is negative) of a token's index vector."""
    def hexdigit(i: int) -> Column:
        return F.conv(F.substring(F.md5(token), i, 1), 16, 10).cast("int")
    return hexdigit(1) * 2 + F.floor(hexdigit(2) / 8).cast("int")


def token_vectors(texts: DataFrame, col: str, reach: int = REACH) -> DataFrame:
    """``(token, vec)``: the vector (``WIDTH`` whole numbers) of every whitespace token of the column ``col``: texts,
    which are counted by native expressions, or arrays of texts, which are counted in slices."""
    if isinstance(texts.schema[col].dataType, T.ArrayType):
        return _sliced_vectors(texts, col, reach)
    words = texts.select(_words(F.col(col)).alias("t")).select("t", F.transform("t", index_code).alias("c"))
    def around(i: Column) -> Column:
        first = F.greatest(i - reach, F.lit(0))
        return F.slice("c", first + 1, F.least(i + 1 + reach, F.size("c")) - first)

    near = F.transform("t", lambda w, i: F.struct(w.alias("token"), around(i).alias("codes")))
    seen = words.select(F.explode(near).alias("o")).select("o.token", F.explode("o.codes").alias("code"))
    counts = seen.groupBy("token", "code").agg(F.count(F.lit(1)).alias("n"))
    at = [F.coalesce(F.sum(F.when(F.col("code") == 2 * k, F.col("n")).when(F.col("code") == 2 * k + 1, -F.col("n"))),
                     F.lit(0)) for k in range(WIDTH)]
    return counts.groupBy("token").agg(F.array(*at).alias("vec"))


def _code(token: bytes) -> int:
    """``index_code`` of one token."""
    digest = md5(token).digest()[0]
    return 2 * (digest >> 4) + ((digest & 15) >> 3)


def count_slice(texts: Counter, reach: int) -> tuple[pa.Array, np.ndarray]:
    """The tokens of ``texts`` (each with how often it occurs) and their vectors, one row a token."""
    words = pairbatch.ws_tokens(list(texts))
    ids, owner, known = words.ids, words.owner, words.words.dictionary
    times = np.fromiter(texts.values(), np.int64, len(texts))[owner]
    codes = np.array([_code(w) for w in known.to_pylist()], dtype=np.int64)[ids] if len(ids) else ids
    spot, sign = codes >> 1, (1 - 2 * (codes & 1)) * times
    out = np.zeros(len(known) * WIDTH)  # whole numbers far below 2^53
    for o in range(min(reach, len(ids) - 1) + 1):
        near = owner[o:] == owner[:len(ids) - o]
        first, last = np.flatnonzero(near), np.flatnonzero(near) + o
        for at, other in ((first, last), (last, first)) if o else ((first, last),):
            out += np.bincount(ids[at] * WIDTH + spot[other], weights=sign[other], minlength=len(out))
    return known.cast(pa.string()), out.reshape(-1, WIDTH).astype(np.int64)


_SUMS = [f"_{k}" for k in range(WIDTH)]


def _slices(df: DataFrame, col: str, reach: int, chunk: str | None = None) -> DataFrame:
    """``(token, _0.._15)``: the sums of each token in slices of the arrays of texts ``col``; with ``chunk``, a column that
    ascends, no slice holds texts of two chunks and its sums carry its number."""
    kept = [chunk] if chunk else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size, at = Counter(), 0, None

        def flush() -> pa.RecordBatch:
            words, sums = count_slice(texts, reach)
            return pa.RecordBatch.from_arrays([*[pa.array([at] * len(words), pa.int64()) for _ in kept], words,
                                               *[pa.array(c) for c in sums.T]], [*kept, "token", *_SUMS])

        for batch in batches:
            where = batch.column(1).to_pylist() if kept else [None] * batch.num_rows
            for own, ts in zip(where, batch.column(0).to_pylist()):
                if texts and (own != at or size > SLICE_CHARS):
                    yield flush()
                    texts, size = Counter(), 0
                at = own
                for t in ts or ():
                    if t:
                        if t not in texts:
                            size += len(t)
                        texts[t] += 1
        if texts:
            yield flush()

    schema = ", ".join([*[f"{c} long" for c in kept], "token string", *[f"{n} long" for n in _SUMS]])
    return df.select(F.col(col), *kept).mapInArrow(count, schema)


def _sliced_vectors(df: DataFrame, col: str, reach: int) -> DataFrame:
    sums = _slices(df, col, reach).groupBy("token").agg(*[F.sum(n).alias(n) for n in _SUMS])
    return sums.select("token", F.array(*_SUMS).alias("vec"))


def best_cosines(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine of each row of ``a`` to a row of ``b`` and the reverse, of rows of length 1 or zero rows, which have
    cosine 0 to everything."""
    if len(a) <= BLOCK and len(b) <= BLOCK:
        cos = a @ b.T
        return cos.max(axis=1), cos.max(axis=0)
    to_b, to_a = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            cos = a[i:i + BLOCK] @ b[j:j + BLOCK].T
            to_b[i:i + BLOCK] = np.maximum(to_b[i:i + BLOCK], cos.max(axis=1))
            to_a[j:j + BLOCK] = np.maximum(to_a[j:j + BLOCK], cos.max(axis=0))
    return to_b, to_a


def _chunked(df: DataFrame, lists: Column, keys: list[str]) -> DataFrame:
    """``keys``, the texts ``_lists`` of a row and the ``_chunk`` it belongs to, written once: a recomputed task can't
    deal its rows anew."""
    rows = df.select(*keys, lists.alias("_lists"))
    most_rows, most_chars = CHUNK_ROWS, CHUNK_CHARS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n, chars = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            lists, where = batch.column(len(keys)), []
            sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.utf8_length(lists.values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
            ends = sizes[lists.offsets.to_numpy()]
            for size in np.diff(ends):
                if n and (n >= most_rows or chars + size > most_chars):
                    chunk, n, chars = chunk + 1, 0, 0
                n, chars = n + 1, chars + int(size)
                where.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int64())], names=[*keys, "_lists", "_chunk"])

    return stored(rows.mapInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("_chunk", T.LongType())])), "match-rows")


def _needed(rows: DataFrame) -> DataFrame:
    """``(_chunk, token)`` of the distinct tokens of every chunk; one that lies in two batches may name a token twice."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, set] = {}
            for chunk, texts in zip(batch["_chunk"].to_pylist(), batch["_lists"].to_pylist()):
                found.setdefault(chunk, set()).update(t for t in texts if t)
            for chunk, texts in found.items():
                words = pairbatch.ws_tokens(list(texts)).words.dictionary.cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(words), pa.int64()), words], names=["_chunk", "token"])
    return rows.select("_chunk", "_lists").mapInArrow(distinct, "_chunk long, token string")


def _ceil(n: np.ndarray) -> np.ndarray:
    """The next size up of few: multiples of 4 to 32, then eighths of a power of 2."""
    step = np.maximum(4, np.exp2(np.ceil(np.log2(np.maximum(n, 1))) - 3).astype(np.int64))
    return -(-n // step) * step


class Bags:
    """The distinct tokens of texts: of text i the elements begin[i]..begin[i + 1] of ``token`` (rows of ``unit``) and
    ``share``, their shares of the text's tokens."""

    def __init__(self, texts: Sequence[str], names: pa.Array, unit: np.ndarray):
        words = pairbatch.ws_tokens(texts)
        place = pc.index_in(words.words.dictionary.cast(pa.string()), value_set=names).fill_null(len(names)).to_numpy(zero_copy_only=False)
        span = max(1, len(place))
        key, n = np.unique(words.owner * span + words.ids, return_counts=True)
        owner = key // span
        self.unit = unit
        self.token = place[key - owner * span].astype(np.int64)
        self.begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.size = np.diff(self.begin)
        self.share = n / np.bincount(owner, weights=n, minlength=len(texts))[owner]

    def _cut(self, texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and shares of the tokens of each text, filled up to ``width`` with its last token, of share 0: a token
        that comes twice moves no maximum."""
        k, size = np.arange(width), self.size[texts][:, None]
        at = self.begin[texts][:, None] + np.minimum(k, size - 1)
        return self.unit[self.token[at]], np.where(k < size, self.share[at], 0.0)

    def match(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Precision and recall of the text pairs (a[i], b[i]); pairs of like sizes are matched together."""
        p, q = np.zeros(len(a)), np.zeros(len(a))
        n, m = self.size[a], self.size[b]
        large = (n > BLOCK) | (m > BLOCK)
        for i in np.flatnonzero(large & (n > 0) & (m > 0)):
            (x, own), (y, other) = ((v[0], w[0]) for v, w in (self._cut(a[i:i + 1], n[i]), self._cut(b[i:i + 1], m[i])))
            to_ref, to_pred = best_cosines(x, y)
            p[i], q[i] = to_ref @ own, to_pred @ other
        some = np.flatnonzero(~large & (n > 0) & (m > 0))
        n, m = _ceil(n[some]), _ceil(m[some])
        order = np.lexsort((m, n))
        some, n, m = some[order], n[order], m[order]
        i = 0
        while i < len(some):
            same = int(np.searchsorted(n, n[i], "right"))
            same = i + int(np.searchsorted(m[i:same], m[i], "right"))
            j = min(same, i + max(1, CELLS // int(n[i] * m[i])))
            own, share = self._cut(a[some[i:j]], int(n[i]))
            ref, ref_share = self._cut(b[some[i:j]], int(m[i]))
            cos = own @ ref.transpose(0, 2, 1)
            p[some[i:j]] = (cos.max(axis=2) * share).sum(axis=1)
            q[some[i:j]] = (cos.max(axis=1) * ref_share).sum(axis=1)
            i = j
        return p, q


def text_match_pairs(df: DataFrame, vectors: DataFrame, pred: str, refs: str, keys: Sequence[str]) -> DataFrame:
    """``keys``, ref_idx, precision, recall, f1 of each (prediction, reference) pair: precision is the mean over the
    prediction's tokens of the best cosine to a token of the reference, recall the reverse, 0 where a text is null or has
    no token. Rows without references (null or empty array) have no pair; rows with equal keys stay apart. Tokens
    without a vector in ``vectors`` count as zero vectors."""
    keys = list(keys)
    return _scored(_chunked(df.filter(F.size(refs) > 0), F.concat(F.array(F.col(pred)), F.col(refs)), keys), vectors, keys)


def _scored(rows: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    # a vocabulary has no bound, so its vectors are never gathered on the driver, whatever a size estimate says
    entries = _needed(rows).join(vectors.hint("merge"), "token").select("_chunk", "token", *[F.col("vec")[k].alias(n) for k, n in enumerate(_SUMS)])
    return _matched(rows, entries, keys)


def _matched(rows: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """``text_match_pairs`` of chunked ``rows``; ``entries`` has the tokens of each chunk and their vectors."""
    names = [*keys, "ref_idx", "precision", "recall", "f1"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        unit = np.zeros((len(right) + 1, WIDTH))  # the last one: no vector
        for k, n in enumerate(_SUMS):
            unit[:-1, k] = right[n].to_numpy()
        norm = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        unit /= np.where(norm > 0, norm, 1)
        known = right["token"].combine_chunks().cast(pa.string())
        lists = left["_lists"].to_pylist()
        took, idx, p, q = [], [], [], []
        for i, j in chunks([sum(len(t or "") for t in ts) for ts in lists], SLICE_CHARS):
            number: dict[str, int] = {}
            at = [[number.setdefault(t or "", len(number)) for t in ts] for ts in lists[i:j]]
            n = np.array([len(ts) - 1 for ts in at], dtype=np.int64)
            ref = np.array([t for ts in at for t in ts[1:]], dtype=np.int64)
            got = Bags(list(number), known, unit).match(np.repeat(np.array([ts[0] for ts in at], dtype=np.int64), n), ref)
            for out, part in zip((took, idx, p, q), (np.repeat(np.arange(i, j), n), np.arange(len(ref)) - np.repeat(np.cumsum(n) - n, n), *got)):
                out.append(part)
        took, idx, p, q = (np.concatenate(x) if x else np.zeros(0) for x in (took, idx, p, q))
        f = np.where(p + q != 0, 2 * p * q / np.where(p + q != 0, p + q, 1), 0.0)  # cosines may be negative
        return pa.table([*[left[c].take(pa.array(took.astype(np.int64))) for c in keys], pa.array(idx.astype(np.int32)), pa.array(p),
                         pa.array(q), pa.array(f)], names=names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["ref_idx int", "precision double", "recall double", "f1 double"])
    return rows.groupBy("_chunk").cogroup(entries.groupBy("_chunk")).applyInArrow(score, schema)


def text_rows(df: DataFrame, pred: str, refs: str, keys: Sequence[str]) -> DataFrame:
    """The texts of all rows of ``df`` in chunks, written once: what ``match_rows`` and ``texts_of`` read."""
    return _chunked(df, F.concat(F.array(F.col(pred)), F.coalesce(refs, F.array().cast("array<string>"))), list(keys))


def texts_of(rows: DataFrame, pred: str, refs: str) -> DataFrame:
    """The rows that ``text_rows`` wrote, with their prediction and references (none for null) as columns again."""
    keys = [c for c in rows.columns if c not in ("_lists", "_chunk")]
    return rows.select(*keys, F.element_at("_lists", 1).alias(pred), F.slice("_lists", F.lit(2), F.size("_lists") - 1).alias(refs))


def match_rows(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``text_match`` of the rows that ``text_rows`` wrote."""
    rows = rows.select(*by, "_lists", "_chunk")
    # a chunk's slices name its tokens and hold its share of their sums: one pass over the texts gives both
    token = Window.partitionBy("token")
    entries = _slices(rows, "_lists", REACH, "_chunk").select("_chunk", "token", *[F.sum(n).over(token).alias(n) for n in _SUMS])
    pairs = _matched(rows, entries, list(by))
    return pairs.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def text_match(df: DataFrame, pred: str, refs: str, by: Sequence[str]) -> DataFrame:
    """F7 + E9 per group of ``by``: the mean scores of its pairs, with vectors from the predictions and references of all
    rows of ``df``."""
    return match_rows(text_rows(df, pred, refs, by), by)
