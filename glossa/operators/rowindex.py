"""Dense 0-based row index in a total order, without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead (SURVEY §4.3):

1. range-partition by the order key and sort inside partitions (distributed sort);
2. tag rows with ``monotonically_increasing_id`` = (partition id << 33) + local
   position, and materialise that with a reliable checkpoint so a recomputed
   partition cannot renumber rows;
3. count rows per partition (one row per partition: a proven bound), turn the
   counts into cumulative offsets, and broadcast-join them back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.session import cut_lineage

_LOCAL_BITS = 33


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_idx",
                partitions: int | None = None, checkpoint: bool = True) -> DataFrame:
    """Add ``name`` = position of the row in ``order`` (ties must not occur:
    pass a unique key as the last order column)."""
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    n = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(n), *order_cols).sortWithinPartitions(*order_cols)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    if checkpoint:
        tagged = cut_lineage(tagged)
    tagged = tagged.withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS)) \
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window below sees at most `n` rows
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off")).fillna(0, ["_off"])
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint")) \
        .drop("_mid", "_pid", "_local", "_off")


@dataclass(frozen=True)
class OrderedTable:
    """A table stored in an order, in files that each hold one range of positions, and the index of those ranges: one
    row (file, first, last) a file. A position or a range of positions reads only the files it lies in."""

    path: str
    schema: T.StructType
    index: DataFrame
    name: str = "row_idx"

    def between(self, first: int, last: int) -> DataFrame:
        """The rows at positions ``first`` to ``last`` (inclusive)."""
        spark = self.index.sparkSession
        files = [r["file"] for r in self.index.filter((F.col("first") <= last) & (F.col("last") >= first)).collect()]
        if not files:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*files).filter(F.col(self.name).between(first, last))

    def at(self, i: int) -> DataFrame:
        return self.between(i, i)


def store_ordered(df: DataFrame, order: Sequence[str | Column], path: str, name: str = "row_idx") -> OrderedTable:
    """Sort once (as ``dense_index``), write the rows with their positions, and index the files by position."""
    spark = df.sparkSession
    dense_index(df, order, name).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(name).alias("first"), F.max(name).alias("last")).write.parquet(f"{path}/index")
    return open_ordered(spark, path, name)


def open_ordered(spark: SparkSession, path: str, name: str = "row_idx") -> OrderedTable:
    return OrderedTable(path, spark.read.parquet(f"{path}/rows").schema, spark.read.parquet(f"{path}/index"), name)
