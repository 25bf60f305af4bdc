"""Operator 7: conflict-constrained best-fit packing of documents into training windows.

A document of ``size`` units fills whole windows of ``capacity`` by itself and leaves one remainder piece (whole texts:
every unit is placed). Pieces are packed best fit in decreasing size: open bins are kept in order of their residual room,
each with two bitmaps, of the sources and of the duplicate clusters it holds. The search starts at the tightest residual
that fits and goes on to its successors until a bin without the piece's source or cluster is found; else a new bin opens.
The result is the tightest compatible bin, exactly as if every bin had been looked at.

The registered query takes the cluster from operator 8 (``near_duplicate_items``), so near copies never share a window.

To keep a frequent source from making that walk long, bins of one residual are grouped by their source bitmap, so a whole
group of bins is passed over at once.

Scale: pieces are dealt into shards by a hash of the row (about ``SHARD_ROWS`` each, so a frequent source or cluster
is spread evenly) and every shard is packed on its own from narrow columns; no text moves. Bins of different shards
never mix, which costs at most the last open bins of each shard.

Defined cases: null or negative sizes count as 0, and pieces of size 0 (null and empty texts) are placed nowhere: one
row with a null bin; a null source or cluster conflicts with nothing; ties in size go by doc_id, then by the row's other
values; repeated rows are separate pieces (of one cluster, if it says so); an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import ngram_join
from glossa.llm.components import connected, hot_join

CAPACITY = 2048
SHARD_ROWS = 8192


class Bins:
    """Open bins ordered by residual room; bins of equal room and equal source bitmap share a group."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms: list[int] = []  # residuals with open bins, ascending
        self.groups: dict[int, dict[int, list[int]]] = {}  # room -> source bitmap -> bins
        self.sources: list[int] = []  # per bin: bitmap of its sources
        self.clusters: list[int] = []

    def _add(self, room: int, b: int) -> None:
        if room not in self.groups:
            self.groups[room] = {}
            insort(self.rooms, room)
        self.groups[room].setdefault(self.sources[b], []).append(b)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece; ``source`` and ``cluster`` are single bits, 0 for none."""
        for at in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[at]
            found = None
            for mask, bins in self.groups[room].items():
                if mask & source:
                    continue
                b = next((b for b in bins if not self.clusters[b] & cluster), None)
                if b is not None and (found is None or b < found):
                    found = b
            if found is not None:
                mask = self.sources[found]
                group = self.groups[room][mask]
                group.remove(found)
                if not group:
                    del self.groups[room][mask]
                    if not self.groups[room]:
                        del self.groups[room]
                        del self.rooms[at]
                self.sources[found] |= source
                self.clusters[found] |= cluster
                if room > size:
                    self._add(room - size, found)
                return found, self.capacity - room
        b = len(self.sources)
        self.sources.append(source)
        self.clusters.append(cluster)
        if self.capacity > size:
            self._add(self.capacity - size, b)
        return b, 0


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best fit decreasing over one shard's rows (doc_id, size, source, cluster)."""
    rows = rows.sort_values(["size", "doc_id", "source", "cluster"], ascending=[False, True, True, True],
                            kind="stable", na_position="last")
    bins, out = Bins(capacity), []
    bit: dict[tuple[str, object], int] = {}

    def flag(kind: str, value) -> int:
        return 0 if pd.isna(value) else 1 << bit.setdefault((kind, value), len(bit))

    whole = []
    for doc, size, source, cluster in rows[["doc_id", "size", "source", "cluster"]].itertuples(index=False):
        for at in range(0, size - size % capacity, capacity):
            whole.append((doc, at, capacity))
        rest = size % capacity
        if rest:
            b, offset = bins.place(rest, flag("source", source), flag("cluster", cluster))
            out.append((doc, size - rest, rest, b, offset))
        elif not size:
            out.append((doc, 0, 0, None, None))
    full = len(bins.sources)
    out += [(doc, at, length, full + k, 0) for k, (doc, at, length) in enumerate(whole)]
    result = pd.DataFrame(out, columns=["doc_id", "start", "length", "bin", "bin_offset"])
    return result.astype({"doc_id": "Int64", "start": "int64", "length": "int64", "bin": "Int64", "bin_offset": "Int64"})


PACK_SCHEMA = "doc_id long, start long, length long, shard int, bin long, bin_offset long"


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of ``items`` (doc_id, size, source, cluster): the document's units [start, start + length) are
    at ``bin_offset`` of ``bin`` in ``shard``."""
    rows = items.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.greatest(F.lit(0), F.coalesce(F.col("size").cast("long"), F.lit(0))).alias("size"),
                        F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    shards = max(1, -(-rows.count() // shard_rows))
    # Equal rows are counted (map-side) and numbered, so even they are spread over the shards, the same on every retry.
    rows = rows.groupBy(*rows.columns).count().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "count"))) \
        .drop("count")
    shard = F.pmod(F.xxhash64(*rows.columns), F.lit(shards)).cast("int")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(group, capacity)
        out.insert(3, "shard", key[0])
        return out

    return rows.groupBy(shard.alias("shard_key")).applyInPandas(run, PACK_SCHEMA)


def text_items(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """Items of a document table: size in white-space words by default, the source, and the cluster of texts that are
    equal but for case and white space. One pass, but near copies are not seen (``near_duplicate_items``)."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    words = F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1)
    return docs.select("doc_id", (words if size is None else size).cast("long").alias("size"), "source",
                       F.md5(plain.cast("binary")).alias("cluster"))


def near_duplicate_items(docs: DataFrame) -> DataFrame:
    """Items with the component of near duplicates (operator 8) as cluster; the size (in words) and the source come with it
    from the one pass that reads the sets. Components that hold texts equal but for case and white space are one cluster
    (the n-grams level the case of ASCII letters only); a text without words has no cluster."""
    known = ngram_join.groups(docs, carry=["source"])
    held = known.filter("c IS NOT NULL").select("level", "c").distinct()  # map-side: a frequent text is a few rows
    several = held.groupBy("level").agg(F.min("c").alias("v"), F.max("c").alias("w")).filter("v <> w").drop("w")
    label = connected(held.join(several, "level").select(F.col("c").alias("u"), "v")).withColumnsRenamed({"node": "c"})
    return hot_join(known, label, "c").select(
        "doc_id", F.col("words").alias("size"), F.col("x0").alias("source"),
        F.coalesce("component", "c").cast("string").alias("cluster"))
