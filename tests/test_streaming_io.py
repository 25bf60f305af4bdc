"""Streaming = batch, replay idempotence, and the I/O round trips."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from glossa.operators import batches as B
from glossa.operators import telemetry as TM
from glossa.operators import textmetrics as TMX
from glossa.sources import fixtures as V
from glossa.sources import io
from glossa.streaming import streams as S


def test_stream_samples_replay_is_idempotent(spark, tmp_path):
    a = V.gen_eval(spark, SF_SMALL).filter(F.col("system") == "A").select("row_id")
    staged = B.assign_batches(a, ["row_id"], 8)
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    S.stage_files(staged.repartition(3, "row_idx"), src)
    S.stream_samples(S.file_stream(spark, src, staged.schema, 1), 5, 3, 8, out, ck).awaitTermination()
    first = sorted(r["row_id"] for r in spark.read.parquet(out).collect())
    # restart from the same checkpoint: nothing new, nothing duplicated
    S.stream_samples(S.file_stream(spark, src, staged.schema), 5, 3, 8, out, ck).awaitTermination()
    again = sorted(r["row_id"] for r in spark.read.parquet(out).collect())
    batch = sorted(r["row_id"] for r in TM.sample_batches(staged, 5, 3).collect())
    assert first == again == batch and len(batch) > 0


def test_samples_have_no_folder_per_sample_batch(spark, tmp_path):
    src, out, ck = _folders(tmp_path)
    staged = spark.range(4000).select("id", F.col("id").alias("row_idx"), (F.col("id") / 8).cast("long").alias("batch_id"))
    S.stage_files(staged.coalesce(2), src)
    S.stream_samples(S.file_stream(spark, src, staged.schema, 1), 5, 3, 8, out, ck).awaitTermination()
    assert [d for d in sorted(os.listdir(out)) if "=" in d] == ["micro_batch=0", "micro_batch=1"]
    got = spark.read.parquet(out)
    assert dict(got.dtypes)["batch_id"] == "bigint" and got.count() == 300


def test_predictions_are_written_in_files_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FILE_ROWS", 10)
    io.write_predictions(spark.range(35).select(F.concat(F.lit("a\n"), "id").alias("t")).coalesce(1), str(tmp_path / "csv"))
    assert sum(f.endswith(".csv") for f in os.listdir(tmp_path / "csv")) == 4


def _folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")


def _means(df):
    return {(r["run"], r["step"]): r["loss_reduced"] for r in df.collect()}


def test_stream_bucket_mean_equals_batch_with_bounded_state(spark, tmp_path):
    """50 micro-batches of a log whose neighbours come out of order: the result is that of the batch operator,
    and the state never holds more than the windows of the delay."""
    log = V.step_log(spark, SF_SMALL).withColumn("run", F.lit("all"))
    src, out, ck = _folders(tmp_path)
    last = log.agg(F.max("ts").alias("t"), F.max("step").alias("s")).first()
    pdf = log.toPandas().sort_values("step")
    size = -(-len(pdf) // 50)
    for k in range(50):
        part = pdf.iloc[k * size:(k + 1) * size].sample(frac=1, random_state=k)
        S.stage_files(spark.createDataFrame(part, log.schema).coalesce(1), src)
    S.stage_files(S.end_of_stream(spark, log.schema, last["t"] + datetime.timedelta(days=3)), src)
    q = S.stream_bucket_mean(S.file_stream(spark, src, log.schema, 1), 50, out, ck, "1 day", "6 hours")
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 50
    # a day of delay and six hours of window hold a few windows of one or two buckets each, at any time
    per_day = last["s"] / 50 / 30
    assert max(sizes) <= 8 * (per_day + 2) and sizes[-1] <= 1
    assert _means(S.read_bucket_mean(spark, out, 50)) == pytest.approx(_means(TM.bucket_mean(log, 50)))


def _steps(rows):
    base = datetime.datetime(2024, 1, 1)
    return [("r", s, float(s), base + datetime.timedelta(minutes=m)) for s, m in rows]


STEP_SCHEMA = "run string, step long, loss double, ts timestamp"


def test_stream_bucket_mean_drops_rows_later_than_the_delay(spark, tmp_path):
    src, out, ck = _folders(tmp_path)
    parts = [_steps((s, s) for s in range(0, 21) if s not in (5, 12)),  # minutes 0 to 20
             _steps((s, s) for s in range(21, 41)),  # the watermark comes to minute 35
             _steps([(12, 12), (39, 39)]),  # 12 is late now; a second row of step 39 is not
             _steps([(5, 400)]),  # an old step with a new time is not late either
             _steps([(41, 600)])]
    for part in parts:
        S.stage_files(spark.createDataFrame(part, STEP_SCHEMA).coalesce(1), src)
        S.stream_bucket_mean(S.file_stream(spark, src, spark.createDataFrame([], STEP_SCHEMA).schema, 1), 10, out, ck,
                             "5 minutes", "5 minutes").awaitTermination()
    kept = spark.createDataFrame([r for p in parts for r in p if r[1] != 12], STEP_SCHEMA)
    want = _means(TM.bucket_mean(kept, 10))
    assert _means(S.read_bucket_mean(spark, out, 10)) == pytest.approx(want)
    assert want["r", 20] == pytest.approx(sum(s for s in range(11, 21) if s != 12) / 9)


def _epoch_rows(spark):
    rows = V.gen_eval(spark, SF_SMALL).filter("row_id % 7 = 0").withColumn("epoch", (F.col("row_id") % 3).cast("int"))
    return rows.withColumn("epoch_end", F.lit(False)).cache()


def _scores(df):
    return {(r["system"], r["epoch"]): [r["blue"], r["chrf"], r["rougeLsum_fmeasure"]] for r in df.collect()}


def test_stream_metrics_emit_each_epoch_once_and_forget_it(spark, tmp_path):
    rows, (src, out, ck) = _epoch_rows(spark), _folders(tmp_path)
    want = _scores(TMX.generation_scores(rows, by=["system", "epoch"]))
    state = []

    def run():
        q = S.stream_metrics(S.file_stream(spark, src, rows.schema, 1), out, ck)
        q.awaitTermination()
        state.extend(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:] if p["stateOperators"])
        return _scores(spark.read.schema("system string, epoch int, blue double, chrf double, rougeLsum_fmeasure double")
                       .parquet(out)), spark.read.parquet(out).count() if os.listdir(out)[1:] else 0

    early = rows.filter("epoch = 1").limit(3)  # rows of the next epoch may come first
    for part in (rows.filter("epoch = 0"), early):
        S.stage_files(part.coalesce(2), src)
    assert run()[0] == {} and state[-1] >= 3  # nothing before the marker
    S.stage_files(S.epoch_end(spark, rows.schema, 0), src)
    got, n = run()
    assert got.keys() == {("A", 0), ("B", 0)} and n == 2 and 1 <= state[-1] <= 2
    ids = [(r.row_id, r.system) for r in early.collect()]
    rest = rows.filter("epoch = 1").filter(~F.concat_ws("-", "row_id", "system").isin([f"{i}-{s}" for i, s in ids]))
    S.stage_files(rest.coalesce(1), src)
    S.stage_files(rows.filter("epoch = 0").limit(5), src)  # late: epoch 0 has ended
    S.stage_files(S.epoch_end(spark, rows.schema, 1), src)
    S.stage_files(rows.filter("epoch = 2").coalesce(1), src)
    S.stage_files(S.epoch_end(spark, rows.schema, 2), src)
    got, n = run()
    assert n == 6 and state[-1] == 0 and got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    again, n = run()  # a restart without new files adds nothing
    assert n == 6 and again == got


def test_stream_metrics_replay_of_an_uncommitted_batch(spark, tmp_path):
    """A run that was lost after its sink had written and before it committed the micro-batch writes the same rows again,
    not more."""
    rows, (src, out, ck) = _epoch_rows(spark).filter("epoch < 2"), _folders(tmp_path)
    for e in (0, 1):
        S.stage_files(rows.filter(F.col("epoch") == e).coalesce(1), src)
        S.stage_files(S.epoch_end(spark, rows.schema, e), src)
    S.stream_metrics(S.file_stream(spark, src, rows.schema, 1), out, ck).awaitTermination()
    want = _scores(spark.read.parquet(out))
    commits = sorted((f for f in os.listdir(f"{ck}/commits") if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{ck}/commits/{f}"):
            os.remove(f"{ck}/commits/{f}")
    S.stream_metrics(S.file_stream(spark, src, rows.schema, 1), out, ck).awaitTermination()
    assert _scores(spark.read.parquet(out)) == want and spark.read.parquet(out).count() == 4


def test_cached_builds_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    calls = []

    def build():
        calls.append(1)
        return V.nli(spark, SF_SMALL).select(*[f.name for f in io.NLI_SCHEMA.fields])

    n1 = io.cached(spark, path, build, schema=io.NLI_SCHEMA).count()
    n2 = io.cached(spark, path, build, schema=io.NLI_SCHEMA).count()
    assert n1 == n2 > 0 and len(calls) == 1


def test_read_reference_style_summary(spark, tmp_path):
    d = tmp_path / "runs"
    d.mkdir()
    (d / "Score_X.json").write_text(json.dumps(
        {"test/blue": 0.45, "test/chrf": 0.52, "epoch": 0, "_tracker": {"runtime": 39},
         "summary": {"test/chrf": 0.52}}, indent=4))
    rows = {(r["run"], r["metric"]): r["value"] for r in io.read_summaries(spark, str(d / "*.json")).collect()}
    assert rows == {("Score_X", "test/blue"): 0.45, ("Score_X", "test/chrf"): 0.52, ("Score_X", "epoch"): 0.0}


def test_predictions_csv_roundtrip_with_newlines_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a \"quoted\"\nline", "g", "r0", "r1", "r2")], io.TEXT_PRED_SCHEMA)
    path = str(tmp_path / "csv")
    io.write_predictions(df, path)
    back = io.read_predictions(spark, os.path.join(path, "*.csv"), with_file=False).collect()
    assert back[0]["input_text"] == "a \"quoted\"\nline"


def test_csv_keeps_blanks_and_empty_texts(spark, tmp_path):
    rows = [("  lead", "trail  ", "", None, "x")]
    io.write_predictions(spark.createDataFrame(rows, io.TEXT_PRED_SCHEMA), str(tmp_path / "c"))
    back = io.read_predictions(spark, str(tmp_path / "c"), with_file=False).collect()
    assert [tuple(r) for r in back] == rows


def test_cached_rebuilds_an_unfinished_folder(spark, tmp_path):
    path = tmp_path / "half"
    path.mkdir()
    (path / "split=test").mkdir()
    rows = V.nli(spark, SF_SMALL).select(*[f.name for f in io.NLI_SCHEMA.fields])
    assert io.cached(spark, str(path), lambda: rows, schema=io.NLI_SCHEMA).count() == rows.count() > 0


def test_observe_batch_collects_metrics_in_the_same_pass(spark):
    g = V.gen_eval(spark, SF_SMALL)
    out, obs = S.observe_batch(g, "gen", F.count(F.lit(1)).alias("rows"),
                               F.sum(F.length("generated_text")).alias("chars"))
    n = out.write.format("noop").mode("overwrite").save() or g.count()
    got = obs.get
    assert got["rows"] == n and got["chars"] > 0


def test_probe_is_deterministic_by_seed(spark):
    from glossa.operators import probe
    from glossa.sources.tables import load
    emb = load(spark, SF_SMALL, "embeddings").select("vec_id", "embedding", "label")
    m1 = probe.fit_probe(emb, hidden=16, n_classes=10, max_iter=5, seed=7)
    m2 = probe.fit_probe(emb, hidden=16, n_classes=10, max_iter=5, seed=7)
    p1 = sorted(tuple(r) for r in probe.score_probe(m1, emb).collect())
    p2 = sorted(tuple(r) for r in probe.score_probe(m2, emb).collect())
    assert p1 == p2 and len(p1) == emb.count()
