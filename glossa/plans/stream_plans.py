"""Streaming queries (I1–I3, K3): each lets its fixture arrive in the folder of a file stream, as wide as the
fixture is, runs the stream to the end with ``availableNow`` (again for what arrives later) and returns the
sink read back as a batch DataFrame."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from glossa.functions.text import tokens
from glossa.operators import batches as B
from glossa.operators import textmetrics as T
from glossa.plans import report_plans
from glossa.plans.analysis_plans import SAMPLE_TEXTS, sample_rows
from glossa.plans.registry import REGISTRY, query
from glossa.session import shared_path
from glossa.streaming import streams as S
from glossa.sources import fixtures as V


def _paths(spark, name):
    base = shared_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    return base + "/in", base + "/out", base + "/ckpt"


# the twin of the report with the epoch as part of the system
_EPOCH_SQL = report_plans.GENERATION_SQL.replace(
    V.SQL["gen_eval"], f"SELECT * REPLACE (system || '/' || (row_id % 2) AS system) FROM ({V.SQL['gen_eval']})")


@query("i1_stream_metrics", ops=("I1",), sql=f"""
SELECT split_part(system, '/', 1) AS system, CAST(split_part(system, '/', 2) AS INTEGER) AS epoch, metric, value
FROM ({_EPOCH_SQL})""")
def i1_stream_metrics(spark, sf):
    src, out, ck = _paths(spark, "metrics")
    # two epochs, odd and even chunks; each arrives, then its end marker, and the metrics start anew
    rows = V.gen_eval(spark, sf).withColumn("epoch", (F.col("row_id") % 2).cast("int")) \
        .withColumn("epoch_end", F.lit(False))
    for epoch in (0, 1):
        S.stage_files(rows.filter(F.col("epoch") == epoch), src)
        S.stage_files(S.epoch_end(spark, rows.schema, epoch), src)
        S.stream_metrics(S.file_stream(spark, src, rows.schema), out, ck).awaitTermination()
    res = spark.read.parquet(out)
    long = T.to_long(res.select("system", "epoch", "blue", "chrf", *T._rouge_cols(T.ROUGE_KEYS)),
                     ["system", "epoch"], T.report_names())
    return long.withColumn("value", F.round("value", 6)).withColumn("epoch", F.col("epoch").cast("int"))


@query("i2_stream_bucket_mean", ops=("I2", "H5"), sql=REGISTRY["h5_bucket_mean"].sql)
def i2_stream_bucket_mean(spark, sf):
    src, out, ck = _paths(spark, "buckets")
    log = V.step_log(spark, sf).withColumn("run", F.lit("all"))
    # the log arrives in four parts by step, as a training job writes it, then its end
    ends = log.agg(F.percentile_approx("step", [0.25, 0.5, 0.75]).alias("q"), F.max("ts").alias("last")).first()
    cuts = [None, *(ends["q"] or []), None]
    for low, high in zip(cuts, cuts[1:]):
        part = log if low is None else log.filter(F.col("step") > low)
        S.stage_files(part if high is None else part.filter(F.col("step") <= high), src)
        S.stream_bucket_mean(S.file_stream(spark, src, log.schema), 50, out, ck).awaitTermination()
    if ends["last"] is not None:
        S.stage_files(S.end_of_stream(spark, log.schema, ends["last"] + datetime.timedelta(hours=2)), src)
        S.stream_bucket_mean(S.file_stream(spark, src, log.schema), 50, out, ck).awaitTermination()
    return S.read_bucket_mean(spark, out, 50).withColumn("loss_reduced", F.round("loss_reduced", 6))


@query("i3_stream_samples", ops=("I3", "H4"), sql=REGISTRY["h4_sample_batches"].sql)
def i3_stream_samples(spark, sf):
    src, out, ck = _paths(spark, "samples")
    g = sample_rows(spark, sf)
    staged = B.assign_batches(g.select("row_id", "system"), ["row_id", "system"], 8).join(g, ["row_id", "system"])
    S.stage_files(staged, src)
    q = S.stream_samples(S.file_stream(spark, src, staged.schema), every=5, n=3, batch_size=8, sink=out,
                         checkpoint=ck)
    q.awaitTermination()
    return spark.read.parquet(out).select("row_id", "system", "row_idx", "batch_id", *SAMPLE_TEXTS)


@query("k3_on_batch", ops=("K3",), sql=V.with_views(
    r"SELECT count(*) AS rows, sum(len(list_filter(regexp_split_to_array(trim(generated_text), '\s+'), "
    r"lambda x: x <> ''))) AS tokens FROM gen_eval", "gen_eval"))
def k3_on_batch(spark, sf):
    src, out, ck = _paths(spark, "hook")
    staged = V.gen_eval(spark, sf).select("row_id", "system", "generated_text")
    S.stage_files(staged, src)

    def hook(batch, batch_id):  # per-batch telemetry, keyed by batch id (idempotent)
        (batch.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(tokens("generated_text"))).alias("tokens"))
         .withColumn("micro_batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("micro_batch")
         .parquet(out))

    S.on_batch(S.file_stream(spark, src, staged.schema), hook, ck).awaitTermination()
    return spark.read.parquet(out).agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"))
