"""Structured Streaming operators.

* I1 ``stream_metrics``: row-level statistics as in the batch path → grouped state of sums, one row per open
  (key, epoch). An end marker closes its epoch: the metrics are computed and emitted once, in append mode,
  and the state is forgotten.
* I2 ``stream_bucket_mean``: sums per (run, bucket, event-time window), emitted once when the watermark
  passes the window and then forgotten, so the state holds the windows of the last ``delay`` only; later
  rows of a closed window are dropped.
* I3 ``stream_samples`` and K3 ``on_batch``: ``foreachBatch`` hooks whose
  writes are keyed by the micro-batch / sample batch so a replay overwrites
  instead of duplicating.

A stream ends like any other event-time stream: rows of open windows or epochs wait in the state. ``end_of_stream``
and the epochs' end markers are rows that only move the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from glossa.operators import textmetrics as TM


def stage_files(df: DataFrame, path: str) -> str:
    """Let the rows of ``df`` arrive in the folder of a file stream, in as many files as ``df`` has partitions.
    What arrives in a later call is read in a later micro-batch, or at least not before."""
    df.write.mode("append").parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """The files of a folder as a stream, ``max_files`` a micro-batch (default: one a core of the cluster)."""
    n = max_files or spark.sparkContext.defaultParallelism
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(path)


def _append(df: DataFrame, sink: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Append to a Parquet sink, whose log makes restarts and replays exactly-once."""
    w = df.writeStream.outputMode("append").format("parquet").option("path", sink) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


# ---- I1 ------------------------------------------------------------------------

_FIRST = 86_400  # event time of epoch 0 in seconds: a watermark begins at 0, and rows at or below it are late
_OPEN_EPOCHS = 2  # rows of the next epoch may come before the end of one; rows of the one after that close it


def epoch_end(spark: SparkSession, schema: T.StructType, epoch: int, column: str = "epoch",
              end: str = "epoch_end") -> DataFrame:
    """The end marker of an epoch: one row of the stream's schema with nothing but the epoch and the flag."""
    row = tuple(epoch if f.name == column else f.name == end or None for f in schema.fields)
    return spark.createDataFrame([row], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))


def epoch_metrics(stream: DataFrame, by: Sequence[str] = ("system",), epoch: str = "epoch",
                  end: str = "epoch_end") -> DataFrame:
    """BLEU / chrF++ / ROUGE per (by…, epoch), each epoch when it has ended. Epochs are the event time: a row of
    epoch e lies at e, the marker of e (``end`` true) at e + 2, and the watermark trails by 2, so it reaches
    e with that marker, not with rows of e + 1. Rows of an epoch that come after its end are dropped."""
    ended = F.coalesce(F.col(end), F.lit(False))
    at = F.timestamp_seconds(F.col(epoch).cast("long") + _FIRST + F.when(ended, _OPEN_EPOCHS).otherwise(0))
    # a marker without references would fall to the filter that exploding them puts below the watermark
    held = F.when(ended, F.array(F.lit(""))).otherwise(F.col(TM.REFS))
    timed = stream.withColumn("epoch_time", at).withColumn(TM.REFS, held).withWatermark("epoch_time", f"{_OPEN_EPOCHS} seconds")
    # markers end here; the condition needs the event time, so it stays above the watermark
    rows = timed.filter(F.unix_seconds("epoch_time") == F.col(epoch) + _FIRST)
    return TM.generation_scores(rows, by=[*by, epoch, "epoch_time"]).drop("epoch_time")


def stream_metrics(stream: DataFrame, sink: str, checkpoint: str, by: Sequence[str] = ("system",),
                   epoch: str = "epoch", end: str = "epoch_end", available_now: bool = True) -> StreamingQuery:
    """Update per micro-batch, compute and reset at the end marker of the epoch: one row per (by…, epoch)."""
    return _append(epoch_metrics(stream, by, epoch, end), sink, checkpoint, available_now)


# ---- I2 ------------------------------------------------------------------------

def bucket_stream(stream: DataFrame, every: int, delay: str, span: str, step: str = "step", value: str = "loss",
                  run: str = "run", event: str = "ts") -> DataFrame:
    """Sum, count and last step per (run, bucket, window of ``span``), once the watermark (``delay`` behind the
    latest event) has passed the window."""
    bucket = F.greatest(F.ceil(F.col(step) / every), F.lit(1)).cast("bigint")
    return stream.withColumn(event, F.col(event).cast("timestamp")).withWatermark(event, delay).groupBy(
        F.window(event, span).alias("window"), F.col(run).alias("run"), bucket.alias("bucket")).agg(
        F.sum(value).alias("total"), F.count(value).alias("n"), F.max(step).alias("last"))


def stream_bucket_mean(stream: DataFrame, every: int, sink: str, checkpoint: str, delay: str = "1 hour",
                       span: str = "1 hour", available_now: bool = True) -> StreamingQuery:
    """The closed windows' parts of each bucket, every part once. Rows may come in any order within
    ``delay`` and steps may be missing: ``read_bucket_mean`` equals the batch operator (H5) on all rows that
    were not late."""
    parts = bucket_stream(stream, every, delay, span).select("run", "bucket", "total", "n", "last")
    return _append(parts, sink, checkpoint, available_now)


def end_of_stream(spark: SparkSession, schema: T.StructType, at, event: str = "ts") -> DataFrame:
    """A row with nothing but an event time: moves the watermark past the windows before ``at``."""
    row = tuple(at if f.name == event else None for f in schema.fields)
    return spark.createDataFrame([row], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))


def read_bucket_mean(spark: SparkSession, sink: str, every: int) -> DataFrame:
    """(run, step, loss_reduced) of the flushed buckets: those whose last step k·N has arrived. The sink holds a
    row per bucket and window it spans, nothing superseded."""
    whole = spark.read.parquet(sink).groupBy("run", "bucket").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("last").alias("last"))
    flushed = whole.filter(F.col("last") == F.col("bucket") * every)
    return flushed.select("run", (F.col("bucket") * every).alias("step"),
                          F.try_divide("total", "n").alias("loss_reduced"))


# ---- I3 / K3 --------------------------------------------------------------------

def on_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
             available_now: bool = True) -> StreamingQuery:
    """K3: run ``fn(batch_df, batch_id)`` at the end of every micro-batch."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fn)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def stream_samples(stream: DataFrame, every: int, n: int, batch_size: int, sink: str, checkpoint: str,
                   batch: str = "batch_id", index: str = "row_idx", available_now: bool = True) -> StreamingQuery:
    """First n rows of every N-th sample batch. With a dense ``row_idx`` the
    position inside a batch is ``row_idx % batch_size``, so the selection is
    stateless and exact whatever the micro-batch boundaries; the sink overwrites
    the ``micro_batch`` partition it writes, so a replay is idempotent. Sample batches grow with
    the input, so they are a column and not a folder each."""
    def write(df: DataFrame, batch_id: int) -> None:
        picked = df.filter(((F.col(batch) + 1) % every == 0) & (F.col(index) % batch_size < n))
        # keyed by micro-batch: a replay rewrites only its own files,
        # and a sample batch split over two micro-batches keeps both halves
        (picked.withColumn("micro_batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("micro_batch").parquet(sink))
    return on_batch(stream, write, checkpoint, available_now)


def observe_batch(df: DataFrame, name: str, *metrics) -> tuple[DataFrame, "Observation"]:
    """K3 for batch jobs: attach named aggregate metrics that are computed while
    the job runs (no second pass); read them from the Observation after an action."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, *metrics), obs
