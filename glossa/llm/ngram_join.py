"""Operator 8: exact near-duplicate join by the Jaccard similarity of word n-gram sets (PPJoin+ on Spark).

1. *Sets.* Each text becomes its sorted distinct 64-bit n-gram hashes; texts with equal sets form one class (the set's
   digest), so copies are never paired. Document frequencies of n-grams are counted over all documents in a
   fixed-size table of ``CELLS`` cells (per-task arrays, summed by slices): frequent n-grams stand out however large the
   corpus, and any frequency table gives a valid order.
2. *Prefixes.* A set's n-grams are ordered rarest first (cell level, then hash). Two sets with Jaccard >= t share an
   n-gram among their first ``n - ceil(t n) + 1``. Only these postings are stored; n-grams posted by one class drop out.
3. *Stars.* Within each n-gram and size class the set with the most shared postings is the head (of near copies, the
   least edited); every set is paired with the best of its heads, and verified pairs give first components. A group of
   k near copies costs about k pairs here instead of k^2 / 2.
4. *Rest.* N-grams whose postings lie in two or more components are joined with themselves, for pairs of different
   components only, with the shorter index prefix on the smaller side, length and positional filters. Links inside a
   component can't change the result, so every class ends in its exact component.
5. *Verification.* Each distinct candidate pair passes the suffix filter (an upper bound of the overlap from 64
   hash-range counts of either set, one division step of PPJoin+'s recursion) and is then decided once on full sets.

Skew: an n-gram occurs once in a class, so even the commonest is a small share of all postings; joins on classes and
components, which a group of copies can make hot, go through ``components.hot_join``. Nothing is collected but the
fixed-size frequency levels and a fixed-size bitmap of candidate texts (which only saves hashing texts, and shuffling
sets, that no pair needs). Intermediate tables are deleted as soon as they have been read for the last time.

Hashes are 64 bits: two different n-grams of compared texts, or two different sets, are taken as equal with a chance of
about pairs / 2^64.

Defined cases: null, empty and blank texts have an empty set, no links, and their own doc_id as component; rows with
equal doc_id are separate rows; a null doc_id never names a component (its row's component is null if no other row of it
has an id); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.components import Scratch, connected, hot_join, store
from glossa.llm.textkit import U64, row_slices, shingle_sets, text_buffer, tidy, word_hashes

WIDTH, PERCENT = 5, 80
CELLS, SLICE = 1 << 22, 1 << 14
BITMAP_BITS = 1 << 24
STAR_ROUNDS = 1
BROADCAST_ROWS = 1_000_000  # of 17 bytes
SLICE_GRAMS = 1 << 21
_COUNTERS = (np.uint8, np.uint16, np.uint32)


def _sets(texts: pa.Array, width: int):
    """(row, sorted n-gram hashes, number of words) of every text."""
    buf, offs = text_buffer(texts)
    for i, j in row_slices(offs):
        words, counts = word_hashes(buf, offs[i:j + 1])
        for k, grams in enumerate(shingle_sets(words, counts, width)):
            yield i + k, grams, int(counts[k])


def digest(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams & U64(CELLS - 1)).astype(np.int64)


def _count(seen: np.ndarray, cells: list[np.ndarray]) -> None:
    seen += np.bincount(np.concatenate(cells), minlength=CELLS).astype(np.uint32)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the smallest integer type that holds them, compressed, after a byte that names the type."""
    kind = next(i for i, t in enumerate(_COUNTERS) if counts.max() <= np.iinfo(t).max)
    return bytes([kind]) + pa.compress(counts.astype(_COUNTERS[kind]).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> np.ndarray:
    kind = np.dtype(_COUNTERS[blob[0]])
    return np.frombuffer(pa.decompress(blob[1:], SLICE * kind.itemsize, codec="zstd", asbytes=True), kind)


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _level(text: str | None) -> int:
    """A digest of the words of a text, all letters in lower case."""
    words = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def read_sets(docs: DataFrame, width: int, carry: list[str]) -> DataFrame:
    """One pass over the texts: kind 0 rows describe a document's set, its number of words and (with ``carry``) a digest
    of its words in lower case; they hold the columns ``carry`` as x0, x1, ... Kind 1 rows are a task's n-gram counts."""
    kinds = dict(docs.dtypes)
    extra = "".join(f", x{k} {kinds[c]}" for k, c in enumerate(carry))
    names = ["kind", "doc_id", "key", "class", "n", "ranges", "words", "level", *[f"x{k}" for k in range(len(carry))],
             "slice", "counts"]

    def run(batches):
        seen, pending, waiting, kept = np.zeros(CELLS, dtype=np.uint32), [], 0, []
        for batch in batches:
            kept = [batch.column(3 + k).type for k in range(len(carry))]
            cls, n, ranges, words = [], [], [], []
            for _, grams, count in _sets(batch.column(1), width):
                n.append(len(grams))
                words.append(count)
                if not len(grams):
                    cls.append(None)
                    ranges.append(None)
                    continue
                pending.append(_cells(grams).astype(np.int32))
                waiting += len(grams)
                if waiting >= SLICE_GRAMS:
                    _count(seen, pending)
                    pending, waiting = [], 0
                cls.append(digest(grams))
                edges = np.searchsorted(grams, np.arange(1, 64, dtype=np.uint64) << U64(58))
                sizes = np.diff(np.concatenate(([0], edges, [len(grams)])))
                ranges.append(np.minimum(sizes, 255).astype(np.uint8).tobytes())
            m = len(n)
            level = [_level(t.as_py()) for t in batch.column(1)] if carry else [None] * m
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), batch.column(0), batch.column(2), pa.array(cls, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(ranges, pa.binary()), pa.array(words, pa.int64()),
                 pa.array(level, pa.int64()), *[batch.column(3 + k) for k in range(len(carry))],
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if waiting:
            _count(seen, pending)
        full = [k for k in range(CELLS // SLICE) if seen[k * SLICE:(k + 1) * SLICE].any()]
        m = len(full)
        if m:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, np.int32)), *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.binary()),
                 *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, t) for t in kept], pa.array(full, pa.int32()),
                 pa.array([_packed(seen[k * SLICE:(k + 1) * SLICE]) for k in full], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("key"), *carry).mapInArrow(
        tidy(run), "kind int, doc_id long, key long, class long, n long, ranges binary, words long, level long" + extra
        + ", slice int, counts binary")


def frequency_levels(counts: DataFrame) -> np.ndarray:
    """uint8 level of each cell (8 per doubling of its count), from the tasks' count slices: summed as streams, a slice's
    arrays at a time, first over groups of map tasks and then over the groups. ``CELLS`` bytes reach the driver."""

    def totals(batches) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = _unpacked(blob).astype(np.uint32)  # below 2**32 n-grams of a cell
                total[k] = total[k] + part if k in total else part
        return total

    def partial(batches):
        for k, v in totals(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(v)], pa.binary())],
                                             names=["slice", "counts"])

    def levels(batches):
        for k, v in totals(batches).items():
            level = np.minimum(255, 8 * np.log2(1.0 + v)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level], pa.binary())],
                                             names=["slice", "level"])

    out = np.zeros(CELLS, dtype=np.uint8)
    dealt = counts.select("slice", "counts", (F.spark_partition_id() % 32).alias("group")).repartition("slice", "group")
    summed = dealt.select("slice", "counts").mapInArrow(tidy(partial), "slice int, counts binary").repartition("slice")
    for r in summed.mapInArrow(tidy(levels), "slice int, level binary").collect():
        out[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["level"], np.uint8)
    return out


def _ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def postings(docs: DataFrame, shared, width: int, percent: int) -> DataFrame:
    """(gram, class, n, pos) for the rare-first prefix of every set, once per class and batch; ``shared``: the broadcast
    levels, of CELLS bytes."""

    def run(batches):
        for batch in batches:
            gram, cls, size, pos, done = [], [], [], [], set()
            for _, grams, _ in _sets(batch.column(0), width):
                n = len(grams)
                key = digest(grams) if n else None
                if not n or key in done:
                    continue
                done.add(key)
                keep = n - _ceil_div(percent * n, 100) + 1
                order = np.argsort(shared.value[_cells(grams)], kind="stable")[:keep]
                gram.append(grams[order].view(np.int64))
                cls.append(np.full(keep, key, np.int64))
                size.append(np.full(keep, n, np.int32))
                pos.append(np.arange(keep, dtype=np.int32))
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (gram, cls, size, pos)],
                                                 names=["gram", "class", "n", "pos"])

    return docs.select("text").mapInArrow(tidy(run), "gram long, class long, n int, pos int")


def _least_overlap(na: str, nb: str, percent: int):
    return F.expr(f"({percent} * ({na} + {nb}) + {99 + percent}) div {100 + percent}")


def _possible(small: str, large: str, percent: int):
    """Length and positional filter on (n, pos) of two postings of one n-gram, the smaller set first. The positional
    bound holds for the first common n-gram, and a linked pair passes by that one."""
    return (F.expr(f"100L * n_{small} >= {percent}L * n_{large}")
            & (F.expr(f"least(n_{small} - pos_{small}, n_{large} - pos_{large})")
               >= _least_overlap(f"CAST(n_{small} AS BIGINT)", f"n_{large}", percent)))


def _bitmap(keys: DataFrame):
    """Fixed-size bitmap of text keys, as a numpy array of bytes; the text of a key that is not in it is in no pair."""
    slot = F.pmod(F.col("key"), F.lit(BITMAP_BITS))
    rows = keys.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)[:len(out) - at]
    return out


def _full_sets(docs: DataFrame, shared, width: int) -> DataFrame:
    """(class, grams) of the texts in the broadcast bitmap, once per batch and class; no other is hashed."""

    def run(batches):
        for batch in batches:
            slot = np.array(batch.column(1)).astype(np.int64) % BITMAP_BITS
            wanted = np.flatnonzero(shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            out = {}
            for _, grams, _ in _sets(batch.column(0).take(pa.array(wanted)), width):
                if len(grams):
                    out.setdefault(digest(grams), grams.view(np.int64))
            if out:
                ends = np.cumsum([0, *map(len, out.values())]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate(list(out.values()))))], names=["class", "grams"])

    return docs.select("text", text_key().alias("key")).mapInArrow(tidy(run), "class long, grams array<long>") \
        .groupBy("class").agg(F.first("grams").alias("grams"))


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, percent: int, tmp: Scratch) -> DataFrame:
    """The linked pairs of the distinct candidates ``pairs`` (u, v): suffix filter on the range counts, then the exact
    test on full sets."""
    spark = docs.sparkSession
    side = classes.select("class", "n", "ranges", "key")

    def bound(batches):
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, 64)
            b = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, 64)
            na, nb = np.array(batch.column(4)), np.array(batch.column(6))
            low = np.minimum(a, b).astype(np.int64)
            both = (a == 255) & (b == 255)  # counts stop at 255: such a range bounds nothing
            top = np.where(both.any(axis=1), np.minimum(na, nb), low.sum(axis=1))
            ok = top * (100 + percent) >= percent * (na + nb)
            yield batch.filter(pa.array(ok)).select(["u", "v", "key_u", "key_v"])

    sized = pairs.join(side.toDF("u", "n_u", "r_u", "key_u"), "u").join(side.toDF("v", "n_v", "r_v", "key_v"), "v") \
        .select("u", "v", "key_u", "key_v", "n_u", "r_u", "n_v", "r_v").filter(
            f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    left = tmp.store(sized.mapInArrow(tidy(bound), "u long, v long, key_u long, key_v long"), "candidates")
    need = left.select(F.col("key_u").alias("key")).unionAll(left.select(F.col("key_v").alias("key")))
    shared = spark.sparkContext.broadcast(_bitmap(need))
    sets = _full_sets(docs, shared, width)  # both joins below reuse its one shuffle

    # row by row in the JVM: a batch of pairs of long sets would not fit in a worker
    full = left.select("u", "v").join(sets.toDF("u", "g_u"), "u").join(sets.toDF("v", "g_v"), "v")
    same, both = F.size(F.array_intersect("g_u", "g_v")), F.size("g_u") + F.size("g_v")
    linked = tmp.store(full.select("u", "v", same.alias("same"), both.alias("both"))
                       .filter(f"100L * same >= {percent}L * (both - same)").select("u", "v"), "links")
    shared.destroy()
    tmp.drop(left)
    return linked


def _tag(common: DataFrame, links: DataFrame | None, tmp: Scratch) -> DataFrame:
    """Postings with their class's component so far, of the n-grams posted by two or more components."""
    if links is None:
        return common.withColumn("c", F.col("class"))
    label = connected(links).withColumnRenamed("node", "class")
    tagged = common.join(label, "class", "left").withColumn("c", F.coalesce("component", "class")).drop("component")
    tagged = tmp.store(tagged, "tagged")
    mixed = tagged.groupBy("gram").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("gram")
    open_ = tmp.store(tagged.join(mixed, "gram", "left_semi"), "open")
    tmp.drop(tagged)
    return open_


def _stars(open_: DataFrame, percent: int) -> DataFrame:
    """One candidate pair (u, v) a class v: the best of the sets of other components that head an n-gram and size class
    of v. Heads are the sets with the most shared postings: the least edited text of a group of near copies shares most,
    and is the one that most others link to."""
    shared = open_.groupBy("class").agg(F.count("*").alias("m"))
    sized = open_.join(shared, "class").withColumn(
        "bin", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))))
    rank = F.struct((-F.col("m")).alias("m"), "class", "n", "pos", "c")
    head = sized.groupBy("gram", "bin").agg(F.min(rank).alias("h")).select(
        "gram", "bin", F.col("h.m").alias("m_u"), F.col("h.class").alias("u"), F.col("h.n").alias("n_u"),
        F.col("h.pos").alias("pos_u"), F.col("h.c").alias("c_u"))
    member = sized.drop("m").withColumnsRenamed({"n": "n_v", "pos": "pos_v", "class": "v"})
    met = member.join(head, ["gram", "bin"]).filter("c <> c_u").filter(
        F.when(F.col("n_u") <= F.col("n_v"), _possible("u", "v", percent)).otherwise(_possible("v", "u", percent)))
    best = met.groupBy("v").agg(F.min(F.struct("m_u", "u", "n_u", "n_v")).alias("h")).select("h.u", "h.n_u", "v", "h.n_v")
    v_first = (F.col("n_v") < F.col("n_u")) | ((F.col("n_v") == F.col("n_u")) & (F.col("v") < F.col("u")))
    return best.select(F.when(v_first, F.col("v")).otherwise(F.col("u")).alias("u"),
                       F.when(v_first, F.col("u")).otherwise(F.col("v")).alias("v")).distinct()


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, key, n, c) of every row of ``docs`` (doc_id, text): a hash of the text, the size of its set and its
    component (null for an empty set). With ``carry`` also ``words``, ``level`` (a digest of the words in lower case)
    and the columns named there, as x0, x1, ..."""
    spark, carry = docs.sparkSession, carry or []
    with Scratch(spark, "ngram-join") as tmp:
        found = tmp.store(read_sets(docs, width, carry), "sets")
        more = ["words", "level", *[f"x{k}" for k in range(len(carry))]] if carry else []
        rows = found.filter("kind = 0").select("doc_id", "key", "class", "n", "ranges", *more)
        shared = spark.sparkContext.broadcast(frequency_levels(found.filter("kind = 1")))
        classes = rows.filter("n > 0").groupBy("class").agg(
            F.first("n").alias("n"), F.first("ranges").alias("ranges"), F.min("key").alias("key"))

        posted = tmp.store(postings(docs, shared, width, percent), "postings")
        shared.destroy()
        # One shuffle serves both the count and the join; an n-gram is in a class once, so no key is hot.
        dealt = posted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gram")
        met = dealt.groupBy("gram").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("gram")
        common = tmp.store(dealt.join(met.hint("shuffle_hash"), "gram", "left_semi"), "common")
        tmp.drop(posted)

        links, tried, open_ = None, None, _tag(common, None, tmp)
        for _ in range(STAR_ROUNDS):
            pairs = tmp.store(_stars(open_, percent), "pairs")
            linked = verify(docs, pairs, classes, width, percent, tmp)
            tried = pairs if tried is None else tried.unionAll(pairs)
            links = linked if links is None else links.unionAll(linked)
            open_ = _tag(common, links, tmp)
        tmp.drop(common)
        index = open_.filter(F.expr(f"pos < n - (2L * {percent} * n + {99 + percent}) div {100 + percent} + 1"))
        a = index.select("gram", *[F.col(x).alias(f"{x}_a") for x in ("class", "n", "pos", "c")])
        b = open_.select("gram", *[F.col(x).alias(f"{x}_b") for x in ("class", "n", "pos", "c")])
        rest = a.join(b, "gram").filter("c_a <> c_b AND (n_a, class_a) < (n_b, class_b)").filter(_possible("a", "b", percent)) \
            .select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).distinct() \
            .join(tried, ["u", "v"], "left_anti")
        links = links.unionAll(verify(docs, rest, classes, width, percent, tmp))
        label = connected(links).withColumnRenamed("node", "class")
        labelled = hot_join(rows.drop("ranges"), label, "class")
        return store(labelled.select("doc_id", "key", "n", F.coalesce("component", "class").alias("c"), *more), "groups")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text); ``percent``: least Jaccard * 100."""
    known = groups(docs, width, percent)
    # a row that shares its component with no other is its own
    several = known.filter(F.col("c").isNotNull()).groupBy("c").agg(
        F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    several = store(several.withColumn("named", F.lit(True)), "least")
    return hot_join(known, several, "c").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, prefixed until none is a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` (all columns) without near duplicates: of each component the row with the smallest doc_id stays (a null
    doc_id only if there is no other; equal ids go by the hash of the text, and of rows equal in both one stays). Rows
    with an empty set all stay."""
    known = groups(docs.select("doc_id", "text"), width, percent).filter(F.col("c").isNotNull())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = store(known.groupBy("c").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
                  .drop("rows"), "first")
    ids = hot_join(known, first, "c", "inner").groupBy("doc_id", "key", "first").count()
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    # names that clash with no column of the documents
    key, of, its, stays = fresh(docs, "key", "fate_id", "fate_key", "stays")
    fate = store(ids.select(F.col("doc_id").alias(of), F.col("key").alias(its), is_first.alias(stays), "count")
                 .filter(~F.col(stays) | (F.col("count") > 1)).drop("count"), "fate")
    rows = docs.withColumn(key, text_key())
    # broadcast up to a checked size, so that the texts stay where they are; beyond it they are shuffled
    small = fate.count() <= BROADCAST_ROWS
    at = rows["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(its))
    kept = rows.join(F.broadcast(fate) if small else fate, at, "left_anti")
    repeated = fate.filter(F.col(stays))
    if not repeated.isEmpty():
        several = rows.join(F.broadcast(repeated) if small else repeated, at, "left_semi")
        kept = kept.unionByName(several.dropDuplicates(["doc_id", key]))
    return kept.drop(key)
