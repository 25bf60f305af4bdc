"""Span tables, user aggregates, the two-tier bigram lookup, chunk dictionaries, snapshots, stored order, linear probe:
each against plain Python."""

import math
import random
import threading
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.operators import attribution as A
from glossa.operators import batches as B
from glossa.operators import lm
from glossa.operators import probe
from glossa.operators import telemetry as TM
from glossa.operators import textmetrics as TX
from glossa.operators import tokens as TK
from glossa.operators import udf as U
from glossa.operators.rowindex import open_ordered, store_ordered
from glossa.sources import io

CELLS = "seq_id long, src_pos long, tgt_pos long, score double"
SPANS = "seq_id long, start long, end long"


# ---- J6 ----------------------------------------------------------------------------------------

def brute_spans(cells, spans):
    own = defaultdict(list)
    for seq, a, b in spans:
        if a is not None and b is not None and a < b:
            own[seq].append((a, b))
    out = defaultdict(float)
    for seq, src, tgt, score in cells:
        joined = sum(any(a < q < b for a, b in own[seq]) for q in range(1, tgt + 1))
        out[seq, src, tgt - joined] += score
    return out


@pytest.mark.parametrize("seed", range(3))
def test_span_table_equals_position_by_position(spark, seed):
    rng = random.Random(seed)
    cells = [(s, i, j, rng.randint(-9, 9) / 8) for s in range(12) for i in range(2) for j in range(rng.randint(1, 15))]
    cells += [(99, 0, j, 1.0) for j in range(300)]  # a sequence with most of the cells
    spans = [(rng.randint(0, 13), rng.randint(0, 12), rng.randint(0, 15)) for _ in range(40)]
    spans += [(99, a, a + 3) for a in range(0, 300, 2)] + [(1, None, 4), (1, 2, None), (1, 3, 3), (1, 5, 2), (2, 4, 6), (2, 6, 8)]
    got = A.span_aggregate(spark.createDataFrame(cells, CELLS), spark.createDataFrame(spans, SPANS), "sum")
    assert {(r.seq_id, r.src_pos, r.tgt_pos): r.score for r in got.collect()} == pytest.approx(brute_spans(cells, spans))


def test_span_table_without_spans_or_cells(spark):
    cells = spark.createDataFrame([(1, 0, j, float(j)) for j in range(4)], CELLS)
    none = spark.createDataFrame([], SPANS)
    got = A.span_aggregate(cells, none, "sum").collect()
    assert sorted((r.tgt_pos, r.score) for r in got) == [(j, float(j)) for j in range(4)]
    assert A.span_aggregate(cells.limit(0), spark.createDataFrame([(1, 0, 2)], SPANS), "sum").count() == 0
    one = A.span_aggregate(cells, spark.createDataFrame([(1, 0, 2)], SPANS), "sum")
    listed = A.span_aggregate(cells, [(0, 2)], "sum")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, listed.collect()))


# ---- K2 ----------------------------------------------------------------------------------------

PRODUCT = U.UserAggregate(lambda: [1.0], lambda s, v: [s[0] * float(np.prod(v))], lambda a, b: [a[0] * b[0]], lambda s: s[0])
MEAN = U.UserAggregate(lambda: [0.0, 0.0], lambda s, v: [s[0] + float(v.sum()), s[1] + len(v)],
                       lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: s[0] / s[1] if s[1] else None)


def test_user_aggregate_over_a_hot_key_in_many_batches(spark):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 200), rng.uniform(0.99, 1.01)) for _ in range(6000)]
    rows += [(None, 2.0), (None, 3.0), (7, None), (500, None)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {r.k: r.p for r in U.user_aggregate(df, PRODUCT, "v", ["k"], "p").collect()}
        want = {r.k: r.p for r in df.groupBy("k").agg(F.product("v").alias("p")).collect()}
        assert got[500] == 1.0 and want.pop(500) is None and got.pop(500)
        assert got == pytest.approx(want) and got[None] == 6.0
        mean = {r.k: r.m for r in U.user_aggregate(df, MEAN, "v", ["k"], "m").collect()}
        assert mean.pop(500) is None
        assert mean == pytest.approx({r.k: r.m for r in df.filter("v is not null").groupBy("k").agg(F.avg("v").alias("m")).collect()})
        whole = U.user_aggregate(df, MEAN, "v", [], "m").collect()
        assert [r.m for r in whole] == pytest.approx([df.agg(F.avg("v")).first()[0]])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_registered_metric_with_a_function_of_the_values(spark):
    U.register_metric(spark, "gap_metric", [("a", "DOUBLE"), ("b", "DOUBLE")], "a - b", lambda v: float(v.max() - v.min()))
    df = spark.createDataFrame([(1, s, float(s * s), 1.0) for s in range(1, 6)], "id long, step long, a double, b double")
    got = {r.step: r.gap_metric for r in U.apply_metric(df, "gap_metric", ["a", "b"], ["id"], "step", [(2, 5)]).collect()}
    assert got == {1: 0.0, 2: 12.0, 3: 0.0}


def test_a_task_sends_one_state_a_span(spark):
    """Spans were merged by one Python group each, twice; now a task's batches share a state, and a batch of spans a call."""
    df = spark.range(4000, numPartitions=2).select((F.col("id") % 3).alias("k"), F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        out = U.user_aggregate(df, MEAN, "v", ["k"], "m")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "AggregateInPandas" not in plan and "ArrowAggregatePython" not in plan
        merges = U.UserAggregate(lambda: [1.0], lambda s, v: s, lambda a, b: [a[0] + b[0]], lambda s: s[0])
        # a state of each of the 2 tasks' 40 batches, merged once each, and the zero
        assert {r.n for r in U.user_aggregate(df, merges, "v", ["k"], "n").collect()} == {81.0}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_of_user_aggregates_stay_exact(spark):
    big = (1 << 60) + 1  # a null beside it made the key a double
    df = spark.createDataFrame([(big, "a", 2.0), (None, "a", 3.0), (big, None, 5.0), (big, "a", 7.0)], "k long, s string, v double")
    got = {(r.k, r.s): r.p for r in U.user_aggregate(df, PRODUCT, "v", ["k", "s"], "p").collect()}
    assert got == {(big, "a"): 14.0, (None, "a"): 3.0, (big, None): 5.0}


def test_functions_of_values_see_nulls_and_run_by_batches(spark):
    U.register_metric(spark, "seen_metric", [("a", "DOUBLE")], "a", lambda v: float(len(v) + 10 * v.isna().sum()))
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, None), (1, 2, None), (2, 1, 4.0)], "id long, step long, a double")
    out = U.apply_metric(df, "seen_metric", ["a"], ["id"], "step")
    assert {(r.id, r.step): r.seen_metric for r in out.collect()} == {(1, 1): 12.0, (1, 2): 11.0, (2, 1): 1.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "AggregateInPandas" not in plan and "ArrowAggregatePython" not in plan


# ---- F10 ---------------------------------------------------------------------------------------

def brute_bigram(train, test):
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    contexts = Counter()
    for (a, _), c in pairs.items():
        contexts[a] += c
    v = len({b for _, b in pairs}) + 1
    return {(k, i): math.log((pairs[a, b] + 1) / (contexts[a] + v))
            for k, t in enumerate(test) for i, (a, b) in enumerate(zip(["<s>", *t], t), 1)}


@pytest.mark.parametrize("hot", (1, 3, 50_000))
def test_two_tier_bigram_lookup_equals_counting(spark, hot):
    rng = random.Random(1)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)] + ["x" * 300] * 20  # a frequent token too long for the broadcast tier
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 12))] for _ in range(120)]
    train, test = texts[:80], [*texts[80:], ["never", "seen", "the", "never"]]
    def frame(t):
        return spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(t)], "row_id long, text string")
    model = lm.fit_bigram(frame(train), "text", hot)
    assert hot == 1 or "<s>" in [r.prev for r in model.hot_contexts.collect()]
    got = {(r.row_id, r.step): r.logprob for r in lm.score_bigram(frame(test), "text", model).collect()}
    assert got == pytest.approx(brute_bigram(train, test))


# ---- C2 ----------------------------------------------------------------------------------------

def test_dictionaries_shuffle_a_repeated_token_once_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(TK, "CHUNK_ROWS", 50)
    rows = [(k, "the " * 40 + f"t{k % 5} rare{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "row_id long, text string").repartition(2)
    vocab = spark.createDataFrame([("the", 3), *[(f"t{k}", 4 + k) for k in range(5)]], "token string, id int")
    numbered = TK.numbered(df, "row_id", "text")
    entries = TK.chunk_entries(numbered, F.array(TK.tokens("text")), vocab, "token")
    chunks = numbered.select(F.expr("_rid div 50")).distinct().count()
    per = {r.key: r["count"] for r in entries.groupBy("key").count().collect()}
    assert per["the"] == chunks <= 10 and entries.count() <= 6 * chunks < 400  # of 16,800 tokens
    monkeypatch.setattr(TK, "BROADCAST_BUDGET", 0)
    got = {r.row_id: r.ids for r in TK.encode(df, "text", vocab, 512, out="ids").collect()}
    assert got == {k: [3] * 40 + [4 + k % 5, TK.UNK, TK.EOS] for k, _ in rows}


def test_both_vocabulary_plans_on_null_and_empty_texts(spark, monkeypatch):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a  b "), (3, " a  b "), (None, "b zz")], "row_id long, text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    found = []
    for budget in (1 << 20, 0):
        monkeypatch.setattr(TK, "BROADCAST_BUDGET", budget)
        ids = TK.encode(df, "text", vocab, 16, out="ids")
        found.append((sorted(map(str, ids.collect())), sorted(map(str, TK.decode(ids, "ids", vocab).collect()))))
    assert found[0] == found[1]


# ---- A2 ----------------------------------------------------------------------------------------

def _table(spark, n, tag):
    return spark.range(n).select("id", F.lit(tag).alias("tag"))


def test_two_builders_never_mix_and_readers_keep_their_snapshot(spark, tmp_path):
    path = str(tmp_path / "table")
    assert io.current(spark, path) is None
    ready, errors = threading.Barrier(2), []

    def build(tag):
        def rows():
            ready.wait(60)  # both have found no snapshot
            return _table(spark, 1000, tag)
        try:
            io.cached(spark, path, rows, partition_by=None).count()
        except Exception as e:  # noqa: BLE001  (a thread's failure must fail the test)
            errors.append(e)
    threads = [threading.Thread(target=build, args=(t,)) for t in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    shown = io.cached(spark, path, lambda: pytest.fail("built again"), partition_by=None)
    assert shown.count() == 1000 and shown.select("tag").distinct().count() == 1
    io.rebuild(spark, path, lambda: _table(spark, 5, "c"), None)
    assert shown.count() == 1000  # the older snapshot's files stay for its reader
    assert io.cached(spark, path, lambda: pytest.fail("built again"), partition_by=None).count() == 5


def test_a_failed_builder_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    broken = _table(spark, 10, "x").withColumn("bad", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        io.rebuild(spark, path, lambda: broken, None)
    assert io.current(spark, path) is None
    io.rebuild(spark, path, lambda: _table(spark, 3, "y"), None)
    with pytest.raises(Exception):
        io.rebuild(spark, path, lambda: broken, None)
    assert io.cached(spark, path, lambda: broken, None).count() == 3


# ---- H3, C12 -----------------------------------------------------------------------------------

def test_a_position_reads_one_file_and_sorts_nothing(spark, tmp_path):
    rows = [(k * 7919 % 5003, f"v{k}") for k in range(5003)]
    df = spark.createDataFrame(rows, "k long, v string").repartition(6)
    store_ordered(df, ["k"], str(tmp_path / "o"))
    table = open_ordered(spark, str(tmp_path / "o"))
    want = sorted(rows)
    assert table.index.count() > 3
    for i in (0, 1, 2500, 5002):
        one = TM.row_at(table, i)
        assert [tuple(r) for r in one.select("k", "v", "row_idx").collect()] == [(*want[i], i)]
        assert len(one.inputFiles()) == 1
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
    assert TM.row_at(table, 5003).count() == 0 and TM.row_at(table, -1).count() == 0
    first = B.first_batches(table, 3, 32)
    assert sorted((r.k, r.batch_id) for r in first.collect()) == [(k, i // 32) for i, (k, _) in enumerate(want[:96])]
    assert len(first.inputFiles()) < table.index.count()


# ---- J3, J4 ------------------------------------------------------------------------------------

def test_linear_probe_equals_the_normal_equations(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 5)), rng.integers(0, 3, 300)
    x[np.arange(300), y] += 3.0
    rows = [(k, [float(c) for c in v], int(c)) for k, (v, c) in enumerate(zip(x, y))]
    odd = [(900, None, 1), (901, [1.0, None, 0.0, 0.0, 0.0], 2), (902, [0.0] * 5, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(4)
    model = probe.fit_linear_probe(df)
    a = np.hstack([x, np.ones((300, 1))])
    penalty = np.diag([1.0] * 5 + [0.0])
    want = np.linalg.solve(a.T @ a + penalty, a.T @ np.eye(3)[y])
    assert model.classes == [0, 1, 2] and np.allclose(model.weights, want)
    got = {r.vec_id: r.predicted_label for r in probe.score_linear_probe(model, df).collect()}
    assert [got[k] for k in range(300)] == list(np.argmax(a @ want, axis=1)) and got[900] is None and got[901] is None
    assert np.mean([got[k] == y[k] for k in range(300)]) > 0.8


def test_ids_of_texts_are_flat_arrays():
    texts = pa.array(["b a", None, "", "  a zz a "] * 300)
    got = TK.ids_of(texts, {"a": 3, "b": 4})
    assert got.to_pylist() == [[4, 3], [], [], [3, TK.UNK, 3]] * 300 and got.values.type == pa.int32()
    assert TK.ids_of(texts.slice(0, 0), {}).to_pylist() == []


def test_char_grams_are_shuffled_as_texts(spark):
    df = spark.createDataFrame([(1, "abcabc"), (1, "abc"), (2, None), (3, "ab"), (None, "a bcd")], "row_id long, t string")
    out = TX.ngrams(df, "t", 3, "char")
    assert sorted(map(tuple, out.filter("row_id is not null").collect())) == [(1, "abc", 3), (1, "bca", 1), (1, "cab", 1)]
    assert sorted((r.gram, r["count"]) for r in out.filter("row_id is null").collect()) == [("abc", 1), ("bcd", 1)]
    lines = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange " in x]
    assert lines and all("gram" not in x for x in lines)
