"""Operator 6: quality classification by importance resampling.

Two bag-of-n-grams generative models over hashed n-grams, one of the target (texts labelled good) and one of the raw
corpus, give each text the log importance weight ``sum_g log p_target(g) / p_raw(g)`` over all its n-grams. N-grams are
case-sensitive words, word pairs (a word followed by itself is one shared pair, so stuttering text is seen whatever its
words) and runs of four bytes, hashed to ``WORD_BUCKETS`` + ``BYTE_BUCKETS`` buckets. The target model has the raw model
as its prior (``PRIOR`` pseudo-counts a bucket on average), so buckets the sample hardly saw weigh nothing. A text of n
n-grams counts in either model as ``HALF * n / (n + HALF)`` n-grams, so a few huge texts don't outweigh a language.

Resampling without replacement is Gumbel top-k: each text's key is its tempered log weight (the mean per n-gram, as if
every text had ``SPAN`` n-grams: a plain sum would order texts by length) plus a Gumbel variate made from a hash of its
doc_id, and the k largest keys are selected. ``k`` is a share of the rows or, by default, the number of texts whose
weight does not speak against them (tempered log weight >= -tolerance).

Scale: raw counts cover all documents (map-side sums of fixed-size count arrays); the target is a bounded sample of the
labelled rows (``TARGET_DOCS``), whose ids are broadcast. The k-th key is found exactly by radix selection: four counts
of at most 65,536 buckets each over a written table of keys, never by a sort or a gathered list.

Defined cases: null and empty texts have no n-gram, a null log weight, and are never selected; without target rows all
log weights are 0; ties on the key go to the smaller doc_id (null doc_ids last), rows equal in both are selected
together; an empty table gives an empty table; ``select_rows`` keeps all columns of its input.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.textkit import U64, mix64, row_slices, text_buffer, word_hashes
from glossa.session import shared_path

WORD_BUCKETS = 1 << 14
BYTE_BUCKETS = 1 << 16
BUCKETS = WORD_BUCKETS + BYTE_BUCKETS
PRIOR = 8.0
TARGET_DOCS = 6000
TOLERANCE = 10.0
HALF = 1000
SPAN = 200.0
LEAST = 30.0
_UNIT = 1 << 20  # counts are kept in whole parts of an n-gram, so sums don't depend on their order
_SAME = U64(0x5851F42D4C957F2D)


def ngram_buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of the texts ``offs``."""
    s, e = int(offs[0]), int(offs[-1])
    rel = offs - s
    rows = len(rel) - 1
    words, counts = word_hashes(buf, offs, lower=False)
    word_row = np.repeat(np.arange(rows), counts)
    pair = mix64(words[1:] * U64(3) + words[:-1])
    pair[words[1:] == words[:-1]] = _SAME
    inside = word_row[1:] == word_row[:-1]
    word = np.concatenate((words, pair[inside])) >> U64(64 - 14)
    row = np.concatenate((word_row, word_row[1:][inside]))
    b = buf[s:e].astype(np.uint32)
    if len(b) < 4:
        return word.astype(np.int64), row
    gram = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))
    gram = (gram * np.uint32(2654435761)) >> np.uint32(16)
    byte_row = np.repeat(np.arange(rows), np.diff(rel))
    whole = byte_row[3:] == byte_row[:-3]
    return (np.concatenate((word.astype(np.int64), gram[whole].astype(np.int64) + WORD_BUCKETS)),
            np.concatenate((row, byte_row[3:][whole])))


@dataclass
class Ratio:
    """log p_target / p_raw by bucket."""

    table: np.ndarray

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of n-grams, log weight) of each text."""
        buf, offs = text_buffer(texts)
        n, w = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, j in row_slices(offs):
            bucket, row = ngram_buckets(buf, offs[i:j + 1])
            n[i:j] = np.bincount(row, minlength=j - i)
            w[i:j] = np.bincount(row, weights=self.table[bucket], minlength=j - i)
        return n, w


def count_models(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) counts over ``docs`` (text, is_target): one row a bucket and task at most."""

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            good = np.array(batch.column(1).to_pylist(), dtype=bool)
            for i, j in row_slices(offs):
                bucket, row = ngram_buckets(buf, offs[i:j + 1])
                share = _UNIT * HALF // (np.bincount(row, minlength=j - i) + HALF)
                each = share[row].astype(np.float64)  # sums stay below 2**53: exact
                raw += np.bincount(bucket, weights=each, minlength=BUCKETS).astype(np.int64)
                if good[i:j].any():
                    of = good[i:j][row]
                    target += np.bincount(bucket[of], weights=each[of], minlength=BUCKETS).astype(np.int64)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])],
                                         names=["bucket", "raw", "target"])

    counts = docs.select("text", "is_target").mapInArrow(run, "bucket int, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratio(bucket: np.ndarray, raw: np.ndarray, target: np.ndarray) -> Ratio:
    """Smoothed log ratio; words and bytes are separate distributions."""
    table = np.zeros(BUCKETS)
    for lo, hi in ((0, WORD_BUCKETS), (WORD_BUCKETS, BUCKETS)):
        at = (bucket >= lo) & (bucket < hi)
        r, t = raw[at] / _UNIT, target[at] / _UNIT
        if not t.sum():
            continue
        prior = r / r.sum()
        strength = PRIOR * len(r)
        table[bucket[at]] = np.log((t + strength * prior) / (t.sum() + strength) / prior)
    return Ratio(table)


def train(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> Ratio:
    """Raw counts over all ``docs``, target counts over a bounded sample of those with quality 1."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    n = good.count()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = good.filter(u < min(1.0, target_docs / max(1, n))).distinct().withColumn("is_target", F.lit(True))
    tagged = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left") \
        .select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    pdf = count_models(tagged).toPandas()  # at most BUCKETS rows
    return ratio(pdf["bucket"].to_numpy(dtype=np.int64), pdf["raw"].to_numpy(), pdf["target"].to_numpy())


def _order_bits(x: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles ``x``."""
    bits = np.ascontiguousarray(x, dtype=np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def gumbel(doc_ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel variates from a hash of doc_id."""
    with np.errstate(over="ignore"):
        h = mix64(mix64(doc_ids.astype(np.int64).view(np.uint64) + U64(seed)) + U64(0x9E3779B97F4A7C15))
    u = ((h >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u))


def _keys(model: Ratio, ids: pa.Array, texts: pa.Array, seed: int):
    n, w = model.weigh(texts)
    missing = np.array(ids.is_null())
    doc = np.array(ids.fill_null(0).cast(pa.int64()))
    calm = SPAN * w / (n + LEAST)
    return n, w, calm, calm + gumbel(doc, seed), np.where(missing, np.int64(2**63 - 1), doc)


KEY_SCHEMA = ("doc_id long, n_grams long, log_weight double, tempered double, gumbel_key double, key_bits long, "
              "tie long")


def weights(docs: DataFrame, model: Ratio, seed: int = 1) -> DataFrame:
    """Log weight and Gumbel key of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n, w, calm, key, tie = _keys(shared.value, batch.column(0), batch.column(1), seed)
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(w, mask=none), pa.array(calm, mask=none),
                 pa.array(key, mask=none), pa.array(_order_bits(key), mask=none), pa.array(tie)],
                names=["doc_id", "n_grams", "log_weight", "tempered", "gumbel_key", "key_bits", "tie"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, KEY_SCHEMA)


def radix_select(rows: DataFrame, column: str, k: int, descending: bool) -> tuple[int, int]:
    """(value of the k-th row by ``column``, rows strictly before it), by four passes that count 16 bits each.
    ``rows`` should be a stored table; k is from 1 to the number of rows."""
    high, left = None, k  # bits found so far, as the column shifted right
    for shift in (48, 32, 16, 0):
        part = rows.filter(F.col(column).isNotNull())
        if high is not None:
            part = part.filter(F.shiftright(column, shift + 16) == high)
        counts = part.groupBy(F.shiftright(column, shift).alias("b")).count().collect()
        for r in sorted(counts, key=lambda r: r["b"], reverse=descending):
            if left <= r["count"]:
                high = r["b"]
                break
            left -= r["count"]
    return high, k - left


@dataclass
class Cut:
    """Rows at or above the k-th key: ``bits`` > the cut's, or equal with ``tie`` at most the cut's."""

    bits: int
    tie: int


def find_cut(keys: DataFrame, k: int) -> Cut:
    """The exact top-k boundary of a stored table of keys."""
    if k < 1:
        return Cut(2**63 - 1, -(2**63))
    bits, before = radix_select(keys, "key_bits", k, descending=True)
    tie, _ = radix_select(keys.filter(F.col("key_bits") == bits), "tie", k - before, descending=False)
    return Cut(bits, tie)


def resample(docs: DataFrame, model: Ratio, share: float | None = None, tolerance: float = TOLERANCE,
             seed: int = 1) -> tuple[DataFrame, Cut]:
    """(stored keys with ``selected``, the cut). ``share`` selects that part of all rows; without it, k is the number
    of rows with ``tempered >= -tolerance``."""
    spark = docs.sparkSession
    path = shared_path(spark, f"resample-{uuid.uuid4().hex}")
    weights(docs, model, seed).write.parquet(path)
    keys = spark.read.parquet(path)
    n, fair = keys.agg(F.count("key_bits"), F.count(F.when(F.col("tempered") >= -tolerance, 1))).first()
    cut = find_cut(keys, fair if share is None else min(n, int(round(share * n))))
    above = (F.col("key_bits") > cut.bits) | ((F.col("key_bits") == cut.bits) & (F.col("tie") <= cut.tie))
    return keys.withColumn("selected", F.coalesce(above, F.lit(False))), cut


def select_rows(docs: DataFrame, model: Ratio, cut: Cut, seed: int = 1) -> DataFrame:
    """The selected rows of ``docs`` with all their columns: keys are computed again beside the text, which costs one
    more pass but moves no text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            n, _, _, key, tie = _keys(shared.value, batch.column(id_at), batch.column(text_at), seed)
            bits = _order_bits(key)
            keep = (n > 0) & ((bits > cut.bits) | ((bits == cut.bits) & (tie <= cut.tie)))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
