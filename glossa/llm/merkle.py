"""Operator 12: Merkle manifest of a dataset, with a membership proof for every row (slot pivot).

Every row is a leaf digest; the leaves of a group (a source), ordered by key, form a tree whose nodes have ``FANOUT``
children, and the group roots, ordered by group, form one more tree. ``H`` is the lowercase hex SHA-256 of its inputs
concatenated, digests as hex text.

1. *Leaves.* One pass over the texts makes the digests; from here on no text moves.
2. *Positions.* The narrow leaf table is range-partitioned by (group, key, leaf), so a hot group is split over as many
   tasks as its rows need; a row's position in its group is its place in its partition plus the rows of the group in
   earlier partitions, from a table of one row per group and partition.
3. *Slot pivot.* ``position div FANOUT`` names the parent; conditional aggregates spread its children into ``FANOUT``
   columns. Concatenating the columns and hashing them gives the parent; omitting a child's own column gives that
   child's siblings. Each level is a table in the shared folder and a ``FANOUT``-th of the one below.
4. *Proofs.* From the roots down, every node's path is its own (left, right) siblings before its parent's path; the
   lowest pivot holds the leaves themselves, so paths reach them without another shuffle of the leaves.

Defined cases: a null field is ``-`` in the leaf, and an empty one ``0:``; a null group is a group of its own, before all
others; a null key comes first in its group; rows of one group and key go by their leaf digest, and repeated rows are
leaves of their own with equal digests (their order can't matter); an empty table gives an empty table; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.components import store

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LOCAL_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(parts: list[Column]) -> Column:
    """H of strings; null parts are absent."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def leaf_digest(values: list[Column]) -> Column:
    return digest([field(v) for v in values])


def positions(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (grp, key, leaf, ...) with ``g`` (the group's rank), ``pos`` (place in the group) and ``n`` (rows of
    the group) instead of grp and key; and the groups (g, n)."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("salt")]
    # the salt splits repeated rows over partitions as well; which of two equal leaves comes first can't be told apart
    ranged = store(leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
                   .sortWithinPartitions(*order).drop("salt").withColumn("at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("part", F.shiftright("at", _LOCAL_BITS))
    runs = store(ranged.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows")), "runs")

    # The groups in order: those that start in a partition follow all that start in earlier ones.
    groups = runs.groupBy("grp").agg(F.min("part").alias("start"), F.sum("rows").alias("n"))
    groups = groups.withColumn("k", F.row_number().over(
        Window.partitionBy("start").orderBy(F.col("grp").asc_nulls_first())).cast("long") - 1)
    begun = groups.groupBy("start").agg(F.count("*").alias("m"))  # one row a partition at most
    before = begun.select("start", (F.sum("m").over(Window.orderBy("start")) - F.col("m")).alias("base"))
    groups = store(groups.join(before, "start").select("grp", (F.col("base") + F.col("k")).alias("g"), "n"), "groups")

    named = groups.select(F.col("grp").alias("of"), "g", "n")
    earlier = F.sum("rows").over(Window.partitionBy("g").orderBy("part")) - F.col("rows")  # one row a partition at most
    offsets = store(runs.join(named, F.col("grp").eqNullSafe(F.col("of"))).select(
        "grp", F.col("part").alias("run_part"), "g", "n", (earlier - F.col("first")).alias("shift")), "offsets") \
        .withColumnRenamed("grp", "of")
    placed = ranged.join(offsets, F.col("grp").eqNullSafe(F.col("of")) & (F.col("part") == F.col("run_part")))
    return (placed.withColumn("pos", F.col("at") + F.col("shift")).drop("of", "run_part", "shift", "at", "part", "grp", "key"),
            groups.select("g", "n"))


def pivot(nodes: DataFrame, cell: Column, fanout: int) -> DataFrame:
    """(g, pos, n, s0, s1, ...) of the parents of ``nodes``: the cells of a parent's children, each in its slot's column."""
    slot = F.col("pos") % fanout
    slots = [F.max(F.when(slot == k, cell)).alias(f"s{k}") for k in range(fanout)]
    return nodes.filter("n > 1").groupBy("g", F.expr(f"pos div {fanout}").alias("up")).agg(F.max("n").alias("n"), *slots) \
        .select("g", F.col("up").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
                *[f"s{k}" for k in range(fanout)])


def tree(leaves: DataFrame, most: int, payload: list[str], fanout: int) -> list[DataFrame]:
    """The stored levels above ``leaves`` (g, pos, n, leaf, ...): parents with their children's digests by slot. The
    lowest also holds its leaves' ``payload``. ``most``: rows of the largest group."""
    levels, below, cell = [], leaves, F.struct("leaf", *payload)
    while most > 1:
        level = pivot(below, cell, fanout)
        kids = [F.col(f"s{k}.leaf") for k in range(fanout)]
        levels.append(store(level.withColumn("leaf", digest(kids)), "level"))
        below, cell, most = levels[-1], F.struct("leaf"), -(-most // fanout)
    return levels


def siblings(slot: Column | int, fanout: int) -> Column:
    """(left, right) siblings of the child in ``slot``: the other slots' columns."""
    def side(keep) -> Column:
        return F.concat_ws("", *[F.when(keep(k), F.col(f"s{k}.leaf")) for k in range(fanout)])
    slot = F.lit(slot) if isinstance(slot, int) else slot
    return F.struct(side(lambda k: slot > k).alias("left"), side(lambda k: slot < k).alias("right"))


def paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, payload: list[str], fanout: int) -> DataFrame:
    """(``leaf``, ``payload``, subroot, path) of every leaf: its siblings from the lowest level upwards, then the path of
    its group in ``tops`` (g, subroot, path)."""
    def under_root(nodes: DataFrame) -> DataFrame:
        return nodes.filter("n = 1").join(tops, "g")

    above = None
    for level in reversed(levels):
        here = under_root(level)
        if above is not None:
            up = above.select("g", F.col("pos").alias("up"), "subroot", F.col("path").alias("rest"),
                              *[f"s{k}" for k in range(fanout)])
            kids = level.filter("n > 1").withColumnsRenamed({f"s{k}": f"own{k}" for k in range(fanout)}) \
                .withColumn("up", F.expr(f"pos div {fanout}")).join(up, ["g", "up"])
            step = siblings(F.col("pos") % fanout, fanout)
            here = here.unionByName(kids.select(
                "g", "pos", "n", "leaf", "subroot", F.concat(F.array(step), F.col("rest")).alias("path"),
                *[F.col(f"own{k}").alias(f"s{k}") for k in range(fanout)]))
        above = here
    columns = ["leaf", *payload, "subroot", "path"]
    lone = under_root(leaves).select(*columns)
    if above is None:
        return lone
    child = F.explode(F.array(*[
        F.struct(F.col(f"s{k}").alias("cell"), F.concat(F.array(siblings(k, fanout)), F.col("path")).alias("path"))
        for k in range(fanout)]))
    held = above.select("subroot", child.alias("child")).filter("child.cell IS NOT NULL")
    return lone.unionByName(held.select(*[F.col(f"child.cell.{c}").alias(c) for c in ("leaf", *payload)], "subroot",
                                        F.col("child.path").alias("path")))


def manifest(rows: DataFrame, payload: list[str], fanout: int = FANOUT) -> DataFrame:
    """Every row of ``rows`` (grp, key, leaf and ``payload``): ``leaf``, ``payload``, the group's ``subroot``, the
    dataset's ``root`` and ``path``, the (left, right) siblings of the row's node on each level up to the root."""
    if not {"key", *payload}.isdisjoint({"grp", "leaf", "subroot", "root", "path"}):
        raise ValueError("the payload has a column name of the manifest")
    leaves, groups = positions(store(rows.select("grp", "key", "leaf", *payload), "leaves"))
    size = groups.agg(F.max("n").alias("most"), F.count("*").alias("groups")).first()
    levels = tree(leaves, size["most"] or 0, payload, fanout)
    roots = reduce(DataFrame.unionByName, [t.filter("n = 1").select("g", "leaf") for t in (leaves, *levels)])

    tops = store(roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"),
                              F.lit(size["groups"]).cast("long").alias("n"), "leaf", F.col("g").alias("of")), "subroots")
    over = tree(tops, size["groups"], ["of"], fanout)
    last = (over[-1] if over else tops).select("leaf").first()  # one row, or none of an empty table
    root = F.lit(last["leaf"] if last else None).cast("string")
    none = F.array().cast("array<struct<left:string,right:string>>")
    crown = rows.sparkSession.range(1).select(F.col("id").alias("g"), root.alias("subroot"), none.alias("path"))
    of_group = paths(tops, over, crown, ["of"], fanout).select(
        F.col("of").alias("g"), F.col("leaf").alias("subroot"), "path")
    return paths(leaves, levels, store(of_group, "crown"), payload, fanout).withColumn("root", root)


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def audit(docs: DataFrame, seen: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, group: str = "source",
          key: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """The manifest of ``docs``, each row checked against what is seen of it: (key, leaf, subroot, root, proof_sha256,
    folded_root, verified). ``seen`` replaces fields by expressions over the row as it is read now; a null condition or
    an equal value leaves the row untampered."""
    now = [(seen or {}).get(c, F.col(c)) for c in fields]
    was = [F.col(c) for c in fields]
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"),
                       leaf_digest(was).alias("leaf"), leaf_digest(now).alias("seen"), F.col(key).cast("long").alias("id"))
    held = manifest(rows, ["seen", "id"], fanout)
    return held.select(F.col("id").alias(key), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       fold(F.col("seen"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_feeds(key: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The tampering of the registered query: texts of even CRC-32 (of the decimal key) lose their line feeds."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return {text: F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))}


def oracle_sql() -> str:
    """DuckDB twin. CRC-32 bit by bit; the trees and the folding of proofs as recursive queries."""
    def enc(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(c if c != "text" else text) for c in FIELDS) + ")"

    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda ch: ord(ch)::BIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), "
           "lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END))")
    even = f"xor({crc}, 4294967295::BIGINT) % 2 = 0"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN {even} THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS seen
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM leaves),
low(lvl, g, pos, n, h) AS (
  SELECT 0, g, pos, n, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, g, pos // {FANOUT}, (max(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY lvl, g, pos // {FANOUT}),
subroots AS (SELECT g, lvl AS height, h AS subroot FROM low WHERE n = 1),
high(lvl, pos, n, h) AS (
  SELECT 0, g, count(*) OVER (), subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // {FANOUT}, (max(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY lvl, pos // {FANOUT}),
top AS (SELECT h AS root FROM high WHERE n = 1),
row_ids AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM placed JOIN subroots USING (g)),
steps AS MATERIALIZED (
  SELECT id, t.lvl, t.pos < CAST(r.pos // pow({FANOUT}, t.lvl) AS BIGINT) AS before, t.pos, t.h
  FROM row_ids r JOIN low t ON t.g = r.g AND t.lvl < r.height
   AND t.pos // {FANOUT} = CAST(floor(r.pos / pow({FANOUT}, t.lvl + 1)) AS BIGINT)
   AND t.pos <> CAST(floor(r.pos / pow({FANOUT}, t.lvl)) AS BIGINT)
  UNION ALL
  SELECT id, r.height + t.lvl, t.pos < CAST(floor(r.g / pow({FANOUT}, t.lvl)) AS BIGINT), t.pos, t.h
  FROM row_ids r JOIN high t ON t.n > 1
   AND t.pos // {FANOUT} = CAST(floor(r.g / pow({FANOUT}, t.lvl + 1)) AS BIGINT)
   AND t.pos <> CAST(floor(r.g / pow({FANOUT}, t.lvl)) AS BIGINT)),
sides AS (
  SELECT id, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE before), '') AS l,
         coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE NOT before), '') AS r
  FROM steps GROUP BY id, lvl),
proofs AS (SELECT id, string_agg(l || r, '' ORDER BY lvl) AS proof FROM sides GROUP BY id),
heights AS (SELECT id, seen, height + (SELECT max(lvl) FROM high) AS levels FROM row_ids),
folded(id, lvl, levels, h) AS (
  SELECT id, 0, levels, seen FROM heights
  UNION ALL
  SELECT f.id, f.lvl + 1, f.levels, sha256(coalesce(s.l, '') || f.h || coalesce(s.r, ''))
  FROM folded f LEFT JOIN sides s ON s.id = f.id AND s.lvl = f.lvl WHERE f.lvl < f.levels)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM row_ids JOIN folded f ON f.id = row_ids.id AND f.lvl = f.levels LEFT JOIN proofs ON proofs.id = row_ids.id, top
"""
