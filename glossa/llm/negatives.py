"""Operator 11: hard negatives for training pairs, in score windows below each positive (slot decomposition).

An anchor's positives are its best rows of the same label; a positive's hard negatives are the best rows of other labels
whose score lies between ``LOW`` and ``HIGH`` per cent of the positive's. The windows of one anchor overlap, so instead of
searching each:

1. *Slots.* The positives' upper limits, falling, cut the scores into disjoint slots (u2, u1], (u3, u2], ...; every
   negative lies in one slot at most. Below a slot's own lower limit no window needs it, so the search stops there.
2. *Combiners.* A task reads its rows in batches, scores them against a block of anchors by one matrix product, and keeps
   the top k of each (anchor, slot); once a slot holds k, only better scores are looked at. What leaves a task is at most
   k rows per anchor and slot, however many rows it read, so no label or group of copies is ever collected.
3. *Suffix merge.* The top k of a window are among the tops of its own slot and those below: at most k rows from each.

Scores are exact integers: products run in float64 while every sum stays below 2^53, else in int64 or Python integers.

Scale: anchors are dealt into blocks of at most ``BLOCK_BYTES`` by a hash of the row, and one block at a time is broadcast
to one pass over the rows (a stated query set against all rows); the rows never move. ``usable`` is written once.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; equal rows
count once; rows that share a vec_id but differ are rows of their own, and none is a positive or negative of its own id;
vectors of different lengths are not compared; an anchor without a positive, or a positive without a row in its window,
gives no rows (a positive of negative score has an empty window); scores beyond 64 bits are compared exactly up to 38
digits and returned as the nearest long; an empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.components import store

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
SCALE = 256
BLOCK_BYTES = 8 << 20
SLICE_SCORES = 1 << 21  # scores held at once in a task
I64 = np.iinfo(np.int64)
_BIG = 10**38 - 1


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, x): the distinct rows that take part, with whole-number components (as doubles)."""
    # floor() gives a long; components too large for one are whole numbers already
    x = F.transform("embedding", lambda c: F.when(F.abs(c.cast("double")) < 2.0**52, F.floor(c.cast("double") * SCALE)
                                                  .cast("double")).otherwise(c.cast("double") * SCALE))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x")).distinct()


class Block:
    """A block of anchors: ids, labels, vectors, and the score limits of their slots (falling; each slot holds the scores
    s with ``floor <= s <= top``)."""

    def __init__(self, rows: pa.Table, slots: int):
        self.number = np.array(rows["number"])
        self.ids = np.array(rows["vec_id"])
        self.label = np.array(rows["label"])
        lists = rows["x"].combine_chunks()
        self.x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        self.top = np.full((len(rows), slots), np.inf)
        self.floor = np.full((len(rows), slots), -np.inf)

    def cut(self, best: pa.Table, low: int, high: int) -> None:
        """Slots from the positives (number, slot, score): each ends at its own upper limit and begins above that of the
        next positive, or at its own lower limit. A slot without a positive is empty."""
        order = np.argsort(self.number)
        row = order[np.searchsorted(self.number, np.array(best["number"]), sorter=order)]
        slot = np.array(best["slot"])
        score = np.array([int(v) for v in best["score"].to_pylist()], dtype=object)
        kind = object if len(score) and max(abs(v) for v in score) * max(abs(low), abs(high)) >= 2**53 else np.float64
        top = np.full((len(self.ids), self.top.shape[1] + 1), -np.inf, dtype=kind)
        floor = np.full(self.top.shape, np.inf, dtype=kind)
        top[row, slot] = score * high // 100
        floor[row, slot] = -(-score * low // 100)
        self.top = top[:, :-1]
        self.floor = np.maximum(floor, top[:, 1:] + 1)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``x`` and of ``y``: float64, int64 or Python integers, as their size needs."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if bound < 2.0**53:
        return x @ y.T
    if bound < 2.0**62 and max(np.abs(x).max(), np.abs(y).max()) < 2.0**62:
        return x.astype(np.int64) @ y.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return whole(x).dot(whole(y).T)


class Tops:
    """The top ``k`` (score, id) of every (anchor, slot), as flat arrays in order."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.shape, self.k = (anchors, slots), k
        self.cell, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.score = np.empty(0, np.float64)
        self.bar = np.full((anchors, slots), -np.inf)  # the k-th best score so far

    def add(self, cell: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(cell):
            return
        if score.dtype != self.score.dtype:  # exact integers of any size once one needs them
            score, self.score = score.astype(object), self.score.astype(object)
            if len(self.score):
                self.score = np.vectorize(int, otypes=[object])(self.score)
            score = np.vectorize(int, otypes=[object])(score)
        cell, score, ids = (np.concatenate(p) for p in ((self.cell, cell), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, cell))
        cell, score, ids = cell[order], score[order], ids[order]
        first = np.r_[True, cell[1:] != cell[:-1]]
        place = np.arange(len(cell)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = place < self.k
        self.cell, self.score, self.id = cell[keep], score[keep], ids[keep]
        full = self.cell[place[keep] == self.k - 1]
        bar = np.asarray(self.score[place[keep] == self.k - 1], dtype=np.float64)
        self.bar.flat[full] = bar if self.score.dtype != object else np.nextafter(bar, -np.inf)


def _search(vectors: DataFrame, shared, slots: int, k: int, same_label: bool) -> DataFrame:
    """(number, slot, vec_id, score): each task's top ``k`` per anchor of the broadcast block and slot."""
    schema = "number long, slot int, vec_id long, score decimal(38,0)"

    def run(batches):
        block: Block = shared.value
        tops = Tops(len(block.ids), slots, k)
        step = max(1, SLICE_SCORES // max(1, len(block.ids)))
        for batch in batches:
            lists = batch.column(2)
            size = np.array(pa.compute.list_value_length(lists))
            rows = np.flatnonzero(size == block.x.shape[1])
            if not len(rows):
                continue
            lists = lists.take(pa.array(rows))
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), block.x.shape[1])
            ids, label = np.array(batch.column(0))[rows], np.array(batch.column(1))[rows]
            for a in range(0, len(rows), step):
                part = slice(a, a + step)
                s = scores(block.x, x[part])
                fits = (block.label[:, None] == label[None, part]) == same_label
                fits &= block.ids[:, None] != ids[None, part]
                for j in range(slots):
                    low = np.maximum(block.floor[:, j], tops.bar[:, j])
                    at, who = np.nonzero(fits & (s <= block.top[:, j, None]) & (s >= low[:, None]))
                    tops.add(at * slots + j, s[at, who], ids[part][who])
        for a in range(0, len(tops.cell), 10_000):
            part = slice(a, a + 10_000)
            value = [int(v) for v in tops.score[part]]
            yield pa.RecordBatch.from_arrays([
                pa.array(block.number[tops.cell[part] // slots]), pa.array((tops.cell[part] % slots).astype(np.int32)),
                pa.array(tops.id[part]), pa.array([max(-_BIG, min(_BIG, v)) for v in value], pa.decimal128(38, 0))],
                names=["number", "slot", "vec_id", "score"])

    return vectors.mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("number", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows of ``vectors`` (vec_id,
    embedding, label) where ``anchors`` holds; ``label`` is the label's expression. Per positive (``positives`` an anchor)
    the first ``negatives`` rows of another label from ``low`` to ``high`` per cent of the positive's score."""
    spark = vectors.sparkSession
    rows = store(usable(vectors, label), "usable")
    length = F.size("x")
    # An anchor's number tells rows that share a vec_id apart; anchors of one length form a block.
    chosen = store(rows.filter(anchors).withColumn("dim", length).withColumn(
        "number", F.xxhash64("vec_id", "label", "x")), "anchors")
    dims = chosen.groupBy("dim").agg(F.count("*").alias("m")).orderBy("dim").collect()  # one row a vector length
    kept, won = [], []
    for dim, m in dims:
        blocks = -(-m * 8 * max(1, dim) // block_bytes)
        for b in range(blocks):
            mine = chosen.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("number"), F.lit(blocks)) == b))
            table = mine.select("number", "vec_id", "label", "x").toArrow()  # about block_bytes
            if not len(table):
                continue
            shared = spark.sparkContext.broadcast(Block(table, 1))
            best = store(_best(_search(rows, shared, 1, positives, True), positives)
                         .select("number", (F.col("rank") - 1).alias("slot"), "vec_id", "score"), "positives")
            shared.destroy()
            block = Block(table, positives)
            block.cut(best.select("number", "slot", "score").toArrow(), low, high)  # ``positives`` rows an anchor
            shared = spark.sparkContext.broadcast(block)
            won.append(store(_best(_search(rows, shared, positives, negatives, False), negatives).drop("rank"), "negatives"))
            shared.destroy()
            kept.append(best)
    if not kept:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    found, slots = (reduce(DataFrame.unionAll, parts) for parts in (kept, won))
    # Suffix merge: a window starts at its positive's own slot and takes those below; k rows of each slot are enough.
    p = found.select("number", F.col("slot").alias("of"), F.col("vec_id").alias("positive_id"), F.col("score").alias("ps"))
    met = p.join(slots.withColumnsRenamed({"vec_id": "negative_id", "score": "ns"}), "number").filter(
        f"slot >= of AND {low} * ps <= 100 * ns AND 100 * ns <= {high} * ps")
    order = Window.partitionBy("number", "of").orderBy(F.desc("ns"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = chosen.select("number", F.col("vec_id").alias("anchor_id"))
    def as_long(c: str) -> Column:
        return F.greatest(F.lit(int(I64.min)), F.least(F.lit(int(I64.max)), F.col(c))).cast("long")
    return ranked.join(named, "number").select(
        "anchor_id", "positive_id", "rank", "negative_id", as_long("ps").alias("positive_score"),
        as_long("ns").alias("negative_score"))


def mine(vectors: DataFrame) -> DataFrame:
    """The registered query: anchors are the rows whose vec_id 50 divides; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, moved)


def oracle_sql() -> str:
    return f"""
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id AND len(a.x) = len(r.x)),
positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
         n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}
"""
