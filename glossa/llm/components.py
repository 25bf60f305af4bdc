"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014), and the
helpers of its kind of work: stored intermediate tables, and joins whose hot keys are split.

Each step is a grouped minimum (map-side combined) and an equi-join. Edges are written to the shared folder after every
round, so a lost executor repeats one round at most."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import shared_path

HOT_KEYS = 64
BROADCAST_ROWS = 250_000  # of two or three longs


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage reliably."""
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of ours in the shared folder; its last reader must have written."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one operator, in one shared folder; ``drop`` deletes one early, leaving the block all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, shared_path(spark, f"{name}-{uuid.uuid4().hex}")
        self.paths: dict[int, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        drop(self.spark, self.folder)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            drop(self.spark, t._scratch_path)


def hot_join(rows: DataFrame, side: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``side`` (stored; few rows a key) on ``key``, left or inner, without a hot task. A side of up
    to ``BROADCAST_ROWS`` rows is broadcast. Beyond that the ``HOT_KEYS`` commonest keys of ``rows`` meet a broadcast piece
    of ``side`` where they lie and all others are shuffled. Null keys match nothing; the result is the same."""
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, how)
    hot = rows.filter(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), key).limit(HOT_KEYS)
    return _split_join(rows, side, key, how, hot.select(key))


def _split_join(rows: DataFrame, side: DataFrame, key: str, how: str, hot: DataFrame) -> DataFrame:
    """The join of ``hot_join`` beyond a broadcast; ``rows`` is read twice and should be stored."""
    hot = F.broadcast(hot.withColumnRenamed(key, f"{key}_hot"))
    is_hot = F.col(key) == F.col(f"{key}_hot")
    there = rows.join(hot, is_hot, "left_semi").join(F.broadcast(side.join(hot, is_hot, "left_semi")), key, how)
    rest = rows.join(hot, is_hot, "left_anti")
    out = there.unionByName(rest.filter(F.col(key).isNotNull()).join(side, key, how))
    if how == "left":
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields if f.name != key]
        out = out.unionByName(rest.filter(F.col(key).isNull()).select("*", *missing))
    return out


def _star(edges: DataFrame, large: bool, small: bool) -> DataFrame:
    """``small``: the nodes' minima may be broadcast."""
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    hubs = low.orderBy(F.desc("k"), "u").limit(HOT_KEYS).select("u")  # nodes with very many links
    low = low.select("u", F.least("u", "m").alias("m"))
    met = near.join(F.broadcast(low), "u") if small else _split_join(near, low, "u", "inner", hubs)
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v: long); the component is the smallest node reachable."""
    with Scratch(links.sparkSession, "edges") as tmp:
        edges, seen = tmp.store(links.select("u", "v").filter("u <> v").distinct(), "edges"), None
        while True:
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == seen or not state[0]:
                return store(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                    edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
            seen, before, small = state, edges, 2 * state[0] <= BROADCAST_ROWS
            half = _star(before, True, small)
            if not small:
                half = tmp.store(half, "large")
            edges = tmp.store(_star(half, False, small), "small")
            tmp.drop(before)
