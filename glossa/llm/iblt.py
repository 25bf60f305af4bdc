"""Operator 3: document fingerprints as invertible Bloom lookup tables, native DataFrame expressions only.

A text's paragraphs (runs between line feeds, cut after sentence ends so that one-line texts have several) become
distinct 64-bit digests. A table has three parts of ``s`` cells; a digest is added to one cell of each part, and a cell
holds the count, the xor of its digests and the xor of their checksums. Subtracting two texts' tables leaves the table
of the paragraphs that differ; peeling its pure cells recovers their digests, round by round. The likeness of two
texts is ``(|X| + |Y| - d) / (|X| + |Y|)`` with d the number of recovered digests (1 for two texts without paragraphs).

If peeling stalls, larger tables are tried: digests are dealt by their leading bits into groups of about
``GROUP``, each with a table of its own in proportion to its digests, kept as its occupied cells, and a group that stalls is
tried again with twice and four times the cells under other hashes. (Should all stall, a chance under one in a million, the
group's digests themselves are compared.) ``coalesce`` evaluates a retry only where the one before failed.

The fingerprint is the smallest table (3 * ``BASE`` cells), written as hex text: equal texts have equal fingerprints.

Successor texts (``next_texts``): documents in descending order of doc_id, the first after the last. doc_id ranges
become buckets (at most ``MAX_BUCKETS`` bounds, from approximate percentiles); the first row of each bucket is also sent
to the bucket before it, and a window per bucket finds each row's successor. The text is shuffled once.

Defined cases: null text is empty; rows that share a doc_id follow each other by length, then hash of the text; a null
doc_id sorts last; a single row is its own successor; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE = 8
SEED = 42
GROUP = 256
RETRIES = ((4, 101), (8, 102), (16, 103))  # cells a part by the number of digests, hash seed
ROUNDS = 12
BUCKET_ROWS = 1024
MAX_BUCKETS = 1 << 16
PARAGRAPH = r"\n|(?<=[.!?]) "

_CELL = "struct(0L AS n, 0L AS k, 0L AS c)"


def digests(text: str) -> str:
    """SQL: distinct paragraph digests of the text expression."""
    return f"array_distinct(transform(array_remove(split({text}, '{PARAGRAPH}'), ''), p -> xxhash64(p)))".replace(
        "\\", "\\\\")


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _slotted(entries: str, s: int) -> str:
    """SQL: entries (n, k, c) with their cell in each part, from the bits of the checksum."""
    slots = ", ".join(f"CAST(pmod(shiftrightunsigned(e.c, {16 * j}), {s}L) AS INT) AS s{j}" for j in range(3))
    return f"transform({entries}, e -> struct(e.n AS n, e.k AS k, e.c AS c, {slots}))"


def table(xs: str, s: int, seed: int) -> str:
    """SQL: the cells of the digests ``xs``, the three parts one after the other."""
    parts = ", ".join(f"transform(sequence(0, {s - 1}), i -> aggregate(filter(es, e -> e.s{j} = i), {_CELL}, "
                      "(a, e) -> struct(a.n + 1L AS n, a.k ^ e.k AS k, a.c ^ e.c AS c)))" for j in range(3))
    entries = f"transform({xs}, x -> struct(1L AS n, x AS k, xxhash64(x, {seed}) AS c))"
    return _let(_slotted(entries, s), "es", f"concat({parts})")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (a, b) -> struct(a.n - b.n AS n, a.k ^ b.k AS k, a.c ^ b.c AS c))"


def peel(cells: str, s: int, seed: int) -> str:
    """SQL: the number of digests recovered by peeling ``cells``; null if it stalls. Each round takes all pure cells
    at once; the state holds the cells left, the digests found and whether nothing was pure."""
    pure = _slotted(f"array_distinct(filter(st.t, p -> abs(p.n) = 1 AND xxhash64(p.k, {seed}) = p.c))", s)
    hit = f"CASE i div {s} WHEN 0 THEN q.s0 WHEN 1 THEN q.s1 ELSE q.s2 END = i % {s}"
    rest = (f"transform(st.t, (cell, i) -> aggregate(filter(pure, q -> {hit}), cell, "
            "(a, q) -> struct(a.n - q.n AS n, a.k ^ q.k AS k, a.c ^ q.c AS c)))")
    step = _let(pure, "pure", f"IF(size(pure) = 0, struct(st.t AS t, st.d AS d, true AS stop), "
                              f"struct({rest} AS t, st.d + size(pure) AS d, false AS stop))")
    state = (f"aggregate(sequence(1, {ROUNDS}), struct({cells} AS t, 0 AS d, false AS stop), "
             f"(st, r) -> IF(st.stop, st, {step}))")
    return _let(state, "res", "IF(forall(res.t, z -> z.n = 0 AND z.k = 0 AND z.c = 0), res.d, CAST(NULL AS INT))")


_ZERO = "{0}.n = 0 AND {0}.k = 0 AND {0}.c = 0"


def _entries(keys: str, n: str, seed: int) -> str:
    """SQL: for each digest its three cells (i: number, n, k, c) in a table of 3 * ``s`` cells, s a power of two."""
    at = ", ".join(f"struct({j}L * s + (shiftrightunsigned(e.c, {16 * j}) & (s - 1L)) AS i, {n} AS n, e.k AS k, e.c AS c)"
                   for j in range(3))
    return (f"flatten(transform(transform({keys}, x -> struct(x AS k, xxhash64(x, {seed}) AS c)), "
            f"e -> array({at})))")


def _combined(rows: str) -> str:
    """SQL: the cells of ``rows`` in order of their number, equal numbers added up, empty cells left out. Sorts plain
    integers (cell number and place in ``rows``) and walks the runs by position: appending to an array or slicing one
    copies all of it."""
    order = "sort_array(transform(rs, (e, at) -> e.i * 4294967296L + at + 1L))"
    ordered = f"transform({order}, o -> element_at(rs, CAST(o & 4294967295L AS INT)))"
    begins = "array_remove(transform(od, (e, at) -> IF(at > 0 AND od[at - 1].i = e.i, 0, at + 1)), 0)"
    run = ("aggregate(sequence(b + 1, stop - 1), od[b - 1], (a, q) -> struct(a.i AS i, a.n + od[q - 1].n AS n, "
           "a.k ^ od[q - 1].k AS k, a.c ^ od[q - 1].c AS c))")
    cell = _let("IF(at + 1 < size(bs), bs[at + 1], size(od) + 1)", "stop", f"IF(stop = b + 1, od[b - 1], {run})")
    return _let(rows, "rs", _let(ordered, "od", _let(begins, "bs", (
        f"filter(transform(bs, (b, at) -> {cell}), z -> NOT ({_ZERO.format('z')}))"))))


def sparse_difference(xs: str, ys: str, grow: int, seed: int) -> str:
    """SQL: number of digests in exactly one of ``xs``, ``ys``; null if peeling stalls. The tables, of ``grow``
    cells a part for each digest, are kept as their occupied cells, so their size costs nothing; a table with negated
    counts is added to subtract it."""
    size = f"CAST(shiftleft(1L, CAST(ceil(log2(greatest(16.0D, {grow}.0D * (size({xs}) + size({ys}))))) AS INT)) AS BIGINT)"
    less = _combined(f"concat({_entries(xs, '1L', seed)}, {_entries(ys, '-1L', seed)})")

    def pure(n: int) -> str:
        return f"array_distinct(transform(filter(st.t, p -> p.n = {n} AND xxhash64(p.k, {seed}) = p.c), p -> p.k))"

    rest = _combined(f"concat(st.t, {_entries('more', '-1L', seed)}, {_entries('less', '1L', seed)})")
    step = _let(pure(1), "more", _let(pure(-1), "less", (
        "IF(size(more) + size(less) = 0, struct(st.t AS t, st.d AS d, true AS stop), "
        f"struct({rest} AS t, st.d + size(more) + size(less) AS d, false AS stop))")))
    state = (f"aggregate(sequence(1, {ROUNDS}), struct({less} AS t, 0 AS d, false AS stop), "
             f"(st, r) -> IF(st.stop, st, {step}))")
    return _let(size, "s", _let(state, "res", "IF(size(res.t) = 0, res.d, CAST(NULL AS INT))"))


def grouped_difference(xs: str, ys: str) -> str:
    """SQL: the same from one table per group of digests, larger ones where a group stalls. Two levels of groups, so a
    long text costs little more than its share."""
    bits = f"CAST(ceil(log2(greatest(1.0D, (size({xs}) + size({ys})) / {GROUP}.0D))) AS INT)"
    in_coarse = "shiftrightunsigned(x, 48) % shiftleft(1, nb div 2) = g"
    in_fine = "shiftrightunsigned(x, 56) % shiftleft(1, nb - nb div 2) = h"
    tries = [sparse_difference("xh", "yh", grow, seed) for grow, seed in RETRIES]
    exact = "size(array_except(xh, yh)) + size(array_except(yh, xh))"
    group = _let(f"filter(xg, x -> {in_fine})", "xh", _let(f"filter(yg, x -> {in_fine})", "yh",
                                                            f"coalesce({', '.join(tries)}, {exact})"))
    total = "aggregate(transform(sequence(0, shiftleft(1, {0}) - 1), {1} -> {2}), 0, (acc, e) -> acc + e)"
    fine = total.format("nb - nb div 2", "h", group)
    coarse = _let(f"filter({xs}, x -> {in_coarse})", "xg", _let(f"filter({ys}, x -> {in_coarse})", "yg", fine))
    return _let(bits, "nb", total.format("nb div 2", "g", coarse))


def likeness(xs: str, ys: str, tx: str, ty: str) -> str:
    """SQL: likeness of the digest sets ``xs`` and ``ys`` with their base tables ``tx``, ``ty``."""
    d = f"coalesce({peel(subtract(tx, ty), BASE, SEED)}, {grouped_difference(xs, ys)})"
    both = f"(size({xs}) + size({ys}))"
    return f"IF({both} = 0, 1.0D, CAST({both} - {d} AS DOUBLE) / {both})"


def as_text(cells: str) -> str:
    """SQL: a table as hex text."""
    return (f"concat_ws('', transform({cells}, z -> concat(lpad(hex(z.n), 4, '0'), lpad(hex(z.k), 16, '0'), "
            "lpad(hex(z.c & 4294967295L), 8, '0'))))")


def _buckets(docs: DataFrame, bucket_rows: int) -> tuple[str, int]:
    """SQL for the bucket of ``doc_id`` (ascending; null ids: -1) by at most ``MAX_BUCKETS`` bounds."""
    n = docs.count()
    parts = min(MAX_BUCKETS, max(1, -(-n // bucket_rows)))
    steps = ",".join(repr(i / parts) for i in range(1, parts))
    bounds = docs.agg(F.expr(f"percentile_approx(doc_id, array({steps}), {max(10000, 20 * parts)})")).first()[0] \
        if parts > 1 else None
    bounds = sorted(set(bounds or []))
    if not bounds:
        return "IF(doc_id IS NULL, -1, 0)", 1
    k = int(len(bounds) ** 0.5) + 1
    fine = [bounds[i:i + k] for i in range(0, len(bounds), k)]
    coarse = "CAST(split('{0}', ',') AS array<bigint>)".format(",".join(str(f[-1]) for f in fine))
    rows = "transform(split('{0}', ';'), f -> CAST(split(f, ',') AS array<bigint>))".format(
        ";".join(",".join(map(str, f)) for f in fine))
    inner = (f"IF(g >= {len(fine)}, {len(bounds)}, g * {k} + size(filter(element_at({rows}, least(g, {len(fine) - 1}) + 1), "
             "b -> b < doc_id)))")
    return f"IF(doc_id IS NULL, -1, {_let(f'size(filter({coarse}, b -> b < doc_id))', 'g', inner)})", len(bounds) + 1


def next_texts(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, next): every row with the text of its successor in descending order of doc_id."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket, _ = _buckets(base.select("doc_id"), bucket_rows)
    base = base.withColumn("bucket", F.expr(bucket))
    heads = base.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    order = sorted(heads, key=lambda r: -r["bucket"])  # one row a bucket
    guests = [(r["head"], order[i - 1]["bucket"]) for i, r in enumerate(order)]
    spark = docs.sparkSession
    guest = spark.createDataFrame(guests, "head long, guest int")  # at most MAX_BUCKETS + 1 rows
    placed = base.join(F.broadcast(guest), F.col("doc_id").eqNullSafe(F.col("head")), "left").select(
        "doc_id", "text", F.explode(F.expr(
            "IF(guest IS NULL, array(struct(bucket AS b, false AS g)), "
            "array(struct(bucket AS b, false AS g), struct(guest AS b, true AS g)))")).alias("at"))
    w = Window.partitionBy("at.b").orderBy(F.col("at.g"), F.desc_nulls_last("doc_id"), F.length("text"), F.xxhash64("text"))
    return placed.withColumn("next", F.lead("text").over(w)).filter("NOT at.g").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness to it and to the next text's."""
    half = "CAST(length(text) div 2 AS INT)"
    rows = next_texts(docs).selectExpr(
        "doc_id", "CAST(length(text) AS BIGINT) AS n_chars", "text", "next",
        f"concat(left(text, length(text) - {half}), left(next, {half})) AS edited")
    sets = rows.selectExpr("doc_id", "n_chars", "sha2(edited, 256) AS edited_sha256", f"{digests('text')} AS own",
                           f"{digests('edited')} AS edit", f"{digests('next')} AS succ")
    tables = sets.selectExpr("*", f"{table('own', BASE, SEED)} AS t_own", f"{table('edit', BASE, SEED)} AS t_edit",
                             f"{table('succ', BASE, SEED)} AS t_succ")
    return tables.selectExpr(
        "doc_id", "n_chars", "edited_sha256", f"{as_text('t_own')} AS fingerprint",
        f"{as_text('t_edit')} AS edited_fingerprint", f"{likeness('own', 'edit', 't_own', 't_edit')} AS near_edited",
        f"{likeness('own', 'succ', 't_own', 't_succ')} AS near_next")
