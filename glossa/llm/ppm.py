"""Operator 1: language identification by prediction by partial matching (PPM).

Training counts, per language, every byte that follows each context of 0 to ``order`` bytes (ASCII letters lower-cased)
and freezes the counts. A byte ``s`` after context ``c`` costs ``-log2 n(c,s) / (n(c) + d(c))`` bits if the language has
seen ``c s``, else the escape ``-log2 d(c) / (n(c) + d(c))`` (``d``: distinct successors, PPM method C; nothing if ``c``
itself is unseen) plus the cost after the context one byte shorter, down to a uniform byte. A text's code length under
a language is the exact sum over all its bytes; the shortest code wins.

The context trees are stored as one hash table per order with the whole escape chain folded into a vector of code
lengths, one number per language, so a byte costs one look-up unless no language knows its longest context.

Scale: the counts come from a bounded sample of labelled rows, each text taken whole: the ``MAX_LANGS`` commonest
languages, of each about ``docs_per_lang`` different texts (``SAMPLE_DOCS`` over all languages), by a hash, until they
hold ``LANG_BYTES`` bytes (``SAMPLE_BYTES`` over all languages; the text that reaches the bound is the last, and counts
in full). The model's size is bounded by the sample. Scoring is one pass over whole texts without a shuffle. Both work
in slices of ``textkit.SLICE_BYTES`` / 4 bytes (a longer text in pieces, with its context carried over).

Defined cases: null or letterless texts are ``und`` with score 0; without any training row every text is ``und``; ties
go to the smaller language value; repeated rows are scored alike; empty tables give empty tables; other columns of the
input are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.components import store
from glossa.llm.textkit import LOWER, SLICE_BYTES, U64, row_slices, text_buffer

ORDER = 4
DOCS_PER_LANG = 600
MAX_LANGS = 512
SAMPLE_DOCS = 12_000
LANG_BYTES = 1 << 22
SAMPLE_BYTES = 1 << 25
_MULT = U64(0x9E3779B97F4A7C15)
_EMPTY = U64(2**64 - 1)


class Table:
    """Open-addressing map from uint64 keys to row numbers."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift = U64(64 - bits)
        self.mask = (1 << bits) - 1
        self.slots = np.full(1 << bits, _EMPTY, dtype=np.uint64)
        self.rows = np.zeros(1 << bits, dtype=np.int32)
        todo = np.arange(len(keys))
        pos = self._home(keys)
        while len(todo):
            free = self.slots[pos] == _EMPTY
            self.slots[pos[free]] = keys[todo[free]]
            won = self.slots[pos] == keys[todo]
            self.rows[pos[won]] = todo[won]
            todo, pos = todo[~won], (pos[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where absent."""
        pos = self._home(keys)
        got = self.slots[pos]
        out = np.where(got == keys, self.rows[pos], -1)
        todo = np.flatnonzero((got != keys) & (got != _EMPTY))
        while len(todo):
            pos_t = (pos[todo] + 1) & self.mask
            pos[todo] = pos_t
            got = self.slots[pos_t]
            hit = got == keys[todo]
            out[todo[hit]] = self.rows[pos_t[hit]]
            todo = todo[~hit & (got != _EMPTY)]
        return out


@dataclass
class Model:
    """Frozen statistics: ``cost[o]`` bits of each known (o+1)-gram and ``escape[o]`` bits of each known o-byte
    context, a column per language."""

    langs: list[str]
    order: int
    gram: list[Table]
    cost: list[np.ndarray]
    context: list[Table]
    escape: list[np.ndarray]


def _keys(b: np.ndarray, width: int) -> np.ndarray:
    """Big-endian integer of the ``width`` bytes that end at each position (the first ``width`` - 1 are partial)."""
    k = b.astype(np.uint64)
    wide = k.copy()
    for j in range(1, width):
        wide[j:] |= k[:-j] << U64(8 * j)
    return wide


def count_ngrams(docs: DataFrame, order: int) -> DataFrame:
    """(lang, width, gram, n) over ``docs`` (text, lang): how often each byte string of 1 to ``order`` + 1 bytes
    occurs. Counted per batch first, so the shuffle carries distinct grams only."""

    def record(name, found):
        for o, parts in enumerate(found):
            if parts:
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(g)), pa.array(np.full(len(g), o + 1, np.int32)),
                     pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "width", "gram", "n"])

    def grams(b, back, found):
        """Adds the grams that end after the first ``back`` bytes of ``b``, which are context."""
        for o in range(min(order + 1, len(b))):
            found[o].append(_keys(b, o + 1)[max(o, back):])

    def run(batches):
        step = SLICE_BYTES // 4
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            lang = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, j in row_slices(offs, step):
                if offs[j] - offs[i] > step:  # one long text
                    for at in range(int(offs[i]), int(offs[j]), step):
                        back = min(order, at - int(offs[i]))
                        found = [[] for _ in range(order + 1)]
                        grams(LOWER[buf[at - back:min(at + step, offs[j])]], back, found)
                        yield from record(lang[i], found)
                    continue
                for name in sorted(set(lang[i:j])):
                    found = [[] for _ in range(order + 1)]
                    for r in i + np.flatnonzero(lang[i:j] == name):
                        grams(LOWER[buf[offs[r]:offs[r + 1]]], 0, found)
                    yield from record(name, found)

    counts = docs.select("text", "lang").mapInArrow(run, "lang string, width int, gram long, n long")
    return counts.groupBy("lang", "width", "gram").agg(F.sum("n").alias("n"))


def build(langs: list[str], order: int, width: np.ndarray, lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Fold counts into code-length vectors, from the shortest grams to the longest. ``lang`` holds indexes."""
    L = len(langs)
    model = Model(langs, order, [], [], [], [])
    lower = np.full((1, L), 8.0)
    for o in range(order + 1):
        at = width == o + 1
        keys, inv = np.unique(gram[at].astype(np.uint64), return_inverse=True)
        seen = np.zeros((len(keys), L))
        seen[inv, lang[at]] = n[at]
        ctx, ctx_inv = np.unique(keys >> U64(8), return_inverse=True)
        total, distinct = np.zeros((len(ctx), L)), np.zeros((len(ctx), L))
        np.add.at(total, ctx_inv, seen)
        np.add.at(distinct, ctx_inv, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            known = -np.log2(seen / (total + distinct)[ctx_inv])
        if o == 0:
            below = np.broadcast_to(lower, (len(keys), L))
        else:
            below = model.cost[-1][model.gram[-1].find(keys & U64((1 << (8 * o)) - 1))]
        model.gram.append(Table(keys))
        model.cost.append(np.where(seen > 0, known, escape[ctx_inv] + below).astype(np.float32))
        model.context.append(Table(ctx))
        model.escape.append(escape.astype(np.float32))
    return model


def _bits(model: Model, b: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Code length in bits of each byte under each language; ``reach``: bytes of context it may use."""
    out = np.zeros((len(b), len(model.langs)), dtype=np.float32)
    k = model.order
    wide = _keys(b, k + 1)
    todo = np.arange(len(b))
    for o in range(k, -1, -1):
        if not len(todo):
            break
        can = reach[todo] >= o
        at = todo[can]
        key = wide[at] & U64((1 << (8 * (o + 1))) - 1)
        row = model.gram[o].find(key)
        hit = row >= 0
        out[at[hit]] += model.cost[o][row[hit]]
        miss = at[~hit]
        ctx = model.context[o].find(key[~hit] >> U64(8))
        known = ctx >= 0
        out[miss[known]] += model.escape[o][ctx[known]]
        todo = np.concatenate((todo[~can], miss)) if not can.all() else miss
    out[todo] += 8.0  # a byte that no language has seen
    return out


def code_lengths(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of every text (rows of ``offs``) under every language."""
    k, rows = model.order, len(offs) - 1
    out = np.zeros((rows, len(model.langs)))
    step = SLICE_BYTES // 4
    for i, j in row_slices(offs, step):
        s, e = int(offs[i]), int(offs[j])
        if j - i == 1:
            for at in range(s, e, step):
                back = min(k, at - s)
                b = LOWER[buf[at - back:min(at + step, e)]]
                out[i] += _bits(model, b, np.minimum(np.arange(len(b)), k))[back:].sum(axis=0, dtype=np.float64)
            continue
        if e == s:
            continue
        rel = offs[i:j + 1] - s
        size = np.diff(rel)
        reach = np.minimum(np.arange(e - s) - np.repeat(rel[:-1], size), k)
        bits = _bits(model, LOWER[buf[s:e]], reach)
        full = np.flatnonzero(size)
        out[i + full] = np.add.reduceat(bits, rel[:-1][full], axis=0, dtype=np.float64)
    return out


def sample_per_lang(docs: DataFrame, docs_per_lang: int) -> DataFrame:
    """(text, lang) of the bounded sample of ``docs`` (doc_id, text, lang; no nulls). A language's share of its rows is
    set from its row count; rows are drawn by a hash of doc_id and text, equal texts of a language count once, and whole
    texts are taken in the order of another hash until the language's bytes are reached."""
    spark = docs.sparkSession
    per = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not per:
        return docs.select("text", "lang").limit(0)
    each, room = min(docs_per_lang, SAMPLE_DOCS / len(per)), min(LANG_BYTES, SAMPLE_BYTES // len(per))
    share = spark.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in per], "lang string, share double")
    u = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = store(docs.join(F.broadcast(share), "lang").filter(u < F.col("share")).select("text", "lang").distinct(),
                  "language-sample")

    place = F.xxhash64("text")
    sizes = drawn.select("lang", place.alias("place"), F.octet_length("text").cast("long").alias("bytes")).toPandas() \
        .sort_values(["lang", "place"])
    taken = sizes[sizes.groupby("lang")["bytes"].cumsum() - sizes["bytes"] < room].groupby("lang")["place"].max()
    last = spark.createDataFrame([(k, int(v)) for k, v in taken.items()], "lang string, last long")
    return drawn.join(F.broadcast(last), "lang").filter(place <= F.col("last")).select("text", "lang")


def train(docs: DataFrame, order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit on ``docs`` (doc_id, text, lang). The distinct grams of the bounded sample come to the driver."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    pdf = count_ngrams(sample_per_lang(rows.select("doc_id", "text", "lang"), docs_per_lang), order).toPandas()
    langs = sorted(pdf["lang"].unique())
    index = pdf["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    return build(langs, order, pdf["width"].to_numpy(), index, pdf["gram"].to_numpy(), pdf["n"].to_numpy())


PREDICTION_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def predict_arrays(model: Model, texts: pa.Array, letters: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """(language, score, bits per byte) of each text. The score is the posterior of the best language among all,
    under equal priors."""
    n = len(texts)
    if not model.langs:
        return ["und"] * n, np.zeros(n), np.zeros(n)
    buf, offs = text_buffer(texts)
    bits = code_lengths(model, buf, offs)
    best = bits.argmin(axis=1)
    low = bits[np.arange(n), best]
    score = 1.0 / np.exp2(low[:, None] - bits).sum(axis=1)
    per_byte = low / np.maximum(1, np.diff(offs))
    lang = [model.langs[b] if ok else "und" for b, ok in zip(best, letters)]
    return lang, np.where(letters, score, 0.0), per_byte


def held_out(modulus: int, remainder: int) -> Column:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == remainder, F.lit(False))


def predict(docs: DataFrame, model: Model, held: Column) -> DataFrame:
    """Language of every whole text; the model's size is bounded by its training sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        for batch in batches:
            has = np.array(batch.column(3).to_pylist(), dtype=bool)
            lang, score, per_byte = predict_arrays(shared.value, batch.column(2), has)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(per_byte)],
                names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text",
                       letters.alias("letters")).mapInArrow(run, PREDICTION_SCHEMA)



def keep_language(docs: DataFrame, model: Model, max_bits_per_byte: float = 6.5) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is in a learned language: not ``und``, and at most
    ``max_bits_per_byte`` under its best language (prose is near 2 to 3, random bytes near 8). Without a model
    nothing can be rejected but letterless texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if not shared.value.langs:
                yield batch
                continue
            _, _, per_byte = predict_arrays(shared.value, batch.column(at), np.ones(batch.num_rows, dtype=bool))
            yield batch.filter(pa.array(per_byte <= max_bits_per_byte))

    return docs.filter(letters).mapInArrow(run, docs.schema)
