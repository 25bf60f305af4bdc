"""Generation metrics (F1–F6, F9, F11, F12) as sufficient statistics.

Plan shape for every corpus metric:

    scan → per-row / per-pair statistics (in-stage, no shuffle)
         → one hash aggregate by the group key (partial map-side, K output rows)
         → closed-form formula on K rows.

Texts are never collected; the only exchange carries one row of partial sums
per task and group. Lengths and the closing formulas are native expressions;
tokenisation and counting run in one Arrow UDF a row for all metrics
(``functions.pairbatch``): n-grams as exact integer keys and LCS as 64-bit
lanes, of a whole batch at once. Native ``array_remove`` counting is
O(distinct × n), quadratic on whole lines of thousands of tokens.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import ngrambatch, pairbatch
from glossa.functions.ngrams import closest_length, word_ngrams
from glossa.functions.text import chrf_words, tokens

PRED, REFS = "generated_text", "references"
SPREAD_CONF = "spark.glossa.spreadTasks"
N_ORDERS = ngrambatch.CHAR_ORDER + ngrambatch.WORD_ORDER


def _by(by) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def spread(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Spread the compact input rows over ``SPREAD_CONF`` tasks where the session sets it (an explicit
    choice for inputs of fewer splits than cores; ``get_session`` sets it for local masters). Rows are
    hashed on the row key when present, so every system's row for one input lands in the same task
    (shared reference statistics are then computed once per batch). Unset, a batch input keeps its
    splits; nothing is run to find their number.

    A stream's micro-batch has as many partitions as the files it picked up (often one), so streams are
    always spread: the shuffle of one micro-batch (bounded by its trigger) is cheap next to the
    CPU-bound per-row metrics it parallelises."""
    spark = df.sparkSession
    tasks = spark.conf.get(SPREAD_CONF, None)
    if tasks is None and not df.isStreaming:
        return df
    n = int(tasks) if tasks else 4 * spark.sparkContext.defaultParallelism
    return df.repartition(n, key) if key in df.columns else df.repartition(n)


def _inputs(df: DataFrame, by: list[str], pred: str, refs: str, key: str = "row_id") -> DataFrame:
    """Only the columns a metric needs (plus the row key, if any, for co-location)."""
    cols = [*by, pred, refs] + ([key] if key in df.columns and key not in by else [])
    return spread(df.select(*cols), key)


# ---- Arrow UDF (a whole batch per call) ----

_INTS, _LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
_KINDS = {"clip": _LONGS, "c": T.IntegerType(), "match": _LONGS, "hyp": _LONGS, "ref": _LONGS, "pl": T.IntegerType()}
_ARROW = {"clip": pa.list_(pa.int64()), "c": pa.int32(), "match": pa.list_(pa.int64()), "hyp": pa.list_(pa.int64()),
          "ref": pa.list_(pa.int64()), "pl": pa.int32()}


@lru_cache(maxsize=None)
def stats_udf(bleu: int = 0, chrf: bool = False, keys: tuple[str, ...] = ()):
    """(text, reference texts) → the statistics of a row that ``pairbatch.score`` names, all metrics in one call: the texts
    cross Arrow as raw strings once, without a copy of the row per reference, and are tokenised once, with the same rules
    as the native expressions. What belongs to a pair is an array with a value per reference."""
    names = [*(["clip", "c", "rl"] if bleu else []), *(["match", "hyp", "ref"] if chrf else []), *(["pl", "tl", *keys] if keys else [])]

    @F.arrow_udf(T.StructType([T.StructField(n, _KINDS.get(n, _INTS)) for n in names]))
    def stats(pred: pa.Array, refs: pa.Array) -> pa.Array:
        got = pairbatch.score(pred.to_pylist(), refs.to_pylist(), bleu, chrf, keys)
        kinds = [_ARROW.get(n, pa.list_(pa.int32())) for n in names]
        return pa.StructArray.from_arrays([pa.array(got.get(n, []), kind) for n, kind in zip(names, kinds)], names)
    return stats


# ---- F1, F9 ------------------------------------------------------------------

def ngrams(df: DataFrame, col: str, n: int, unit: str = "word", keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """``(keys…, gram, count)``; word grams are space-joined tokens, char
    grams are substrings of the text without spaces. The keys hold a row key,
    so the texts are dealt out by them and their windows never leave the task.

    The unit array is projected first, so the window lambda reads a column
    instead of re-evaluating the tokenisation per position (O(L²)); character
    windows are sliced from the character array, as ``substring`` by character
    index rescans the text from its start."""
    if unit == "word":
        units = tokens(col)
    elif unit == "char":
        units = F.split(F.regexp_replace(F.trim(F.col(col)), " ", ""), "")
    elif unit == "chrf_word":
        units = chrf_words(col)
    else:
        raise ValueError(unit)
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(*keys, col).repartition(n_tasks, *keys).select(*keys, units.alias("_u"))
    u = F.col("_u")
    if unit == "char":
        grams = F.when(F.size(u) >= n, F.transform(F.sequence(F.lit(1), F.size(u) - n + 1),
                                                   lambda i: F.concat(*[F.element_at(u, i + j) for j in range(n)]))) \
            .otherwise(F.array().cast("array<string>"))
    else:
        grams = word_ngrams(u, n)
    return (base.select(*keys, F.explode(grams).alias("gram"))
            .groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("count")))


def expand_refs(df: DataFrame, refs: str = REFS) -> DataFrame:
    """one row per (prediction, reference) with ``ref_idx`` 0-based."""
    others = [c for c in df.columns if c != refs]
    return df.select(*others, F.posexplode(refs).alias("ref_idx", "reference"))


# ---- row statistics ------------------------------------------------------------

def _bleu_cols(df: DataFrame, n_max: int) -> DataFrame:
    """Adds bleu_c, bleu_r, bleu_num_k, bleu_den_k (k = 1..n_max) from the statistics ``_h``."""
    c = F.col("_h.c")
    out = df.withColumn("bleu_c", c).withColumn("bleu_r", closest_length(c, F.col("_h.rl")))
    for k in range(1, n_max + 1):
        out = out.withColumn(f"bleu_num_{k}", F.col("_h.clip")[k - 1])
        out = out.withColumn(f"bleu_den_{k}", F.greatest(c - (k - 1), F.lit(0)).cast("bigint"))
    return out


def _bleu_stats(df: DataFrame, pred: str, refs: str, n_max: int) -> DataFrame:
    """Adds bleu_c, bleu_r, bleu_num_k, bleu_den_k (k = 1..n_max) per row."""
    return _bleu_cols(df.withColumn("_h", stats_udf(n_max)(F.col(pred), F.col(refs))), n_max).drop("_h")


def _bleu_formula(n_max: int) -> Column:
    nums = [F.col(f"bleu_num_{k}") for k in range(1, n_max + 1)]
    dens = [F.col(f"bleu_den_{k}") for k in range(1, n_max + 1)]
    log_mean = sum((F.log(nm / dn) for nm, dn in zip(nums, dens)), F.lit(0.0)) / n_max
    c, r = F.col("bleu_c"), F.col("bleu_r")
    bp = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    return F.when(F.least(*nums) == 0, F.lit(0.0)).otherwise(bp * F.exp(log_mean))


def _bleu_sums(n_max: int) -> list[Column]:
    cols = ["bleu_c", "bleu_r"] + [f"bleu_{x}_{k}" for k in range(1, n_max + 1) for x in ("num", "den")]
    return [F.sum(c).alias(c) for c in cols]


def bleu(df: DataFrame, pred: str = PRED, refs: str = REFS, n_max: int = 3, by=None) -> DataFrame:
    """corpus BLEU (clipped by the max reference count, closest reference
    length with the first listed winning ties, uniform weights, no smoothing)."""
    stats = _bleu_stats(_inputs(df, _by(by), pred, refs), pred, refs, n_max)
    return stats.groupBy(*_by(by)).agg(*_bleu_sums(n_max)).select(*_by(by), _bleu_formula(n_max).alias("bleu"))


def _chrf_sums() -> list[Column]:
    out = []
    for part in ("match", "hyp", "ref"):
        out += [F.sum(F.col("_h")[part][o]).alias(f"chrf_{part}_{o}") for o in range(N_ORDERS)]
    return out


def _chrf_formula() -> Column:
    b2 = ngrambatch.BETA ** 2
    total = F.lit(0.0)
    for o in range(N_ORDERS):
        m, h, r = (F.col(f"chrf_{p}_{o}") for p in ("match", "hyp", "ref"))
        p = F.when(h > 0, m / h).otherwise(0.0)
        rc = F.when(r > 0, m / r).otherwise(0.0)
        den = b2 * p + rc
        total = total + F.when(den > 0, (1 + b2) * p * rc / den).otherwise(0.0)
    return total / N_ORDERS


def chrf(df: DataFrame, pred: str = PRED, refs: str = REFS, by=None) -> DataFrame:
    """corpus chrF++ (char order 6, word order 2, beta 2) from the counts of
    each sentence's best reference."""
    stats = _inputs(df, _by(by), pred, refs).withColumn("_h", stats_udf(chrf=True)(F.col(pred), F.col(refs)))
    return stats.groupBy(*_by(by)).agg(*_chrf_sums()).select(*_by(by), _chrf_formula().alias("chrf"))


# ---- ROUGE (pair level) ------------------------------------------------------------

def _prf(df: DataFrame, hits: Column, p_len: Column, r_len: Column, name: str) -> DataFrame:
    """Adds {name}_precision/recall/fmeasure. Hits and lengths are materialised
    first so the (expensive) hit expression is evaluated once per pair."""
    h, pl, rl = f"_{name}_h", f"_{name}_pl", f"_{name}_rl"
    df = df.withColumn(h, hits).withColumn(pl, p_len).withColumn(rl, r_len)
    zero = (F.col(pl) == 0) | (F.col(rl) == 0)
    df = df.withColumn(f"{name}_precision", F.when(zero, 0.0).otherwise(F.col(h) / F.col(pl))) \
        .withColumn(f"{name}_recall", F.when(zero, 0.0).otherwise(F.col(h) / F.col(rl)))
    p, r = F.col(f"{name}_precision"), F.col(f"{name}_recall")
    return df.withColumn(f"{name}_fmeasure", F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(0.0)) \
        .drop(h, pl, rl)


ROUGE_KEYS = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def rouge_pairs(df: DataFrame, pred: str = PRED, refs: str = REFS, keys=ROUGE_KEYS,
                carry: Sequence[str] = ()) -> DataFrame:
    """Per (prediction, reference) pair: P/R/F for the requested ROUGE keys.

    Hit counts and token counts of all pairs of a row come from one Python call
    on its texts; the references are exploded (F9) to number the pairs.
    """
    keys = tuple(keys)
    if keys:
        df = df.withColumn("_h", stats_udf(keys=keys)(F.col(pred), F.col(refs)))
    return _pairs(df, refs, keys, carry)


def _pairs(df: DataFrame, refs: str, keys: tuple[str, ...], carry: Sequence[str]) -> DataFrame:
    """Per (prediction, reference) pair: P/R/F from the row's statistics ``_h``."""
    pairs = df.select("*", F.posexplode(refs).alias("ref_idx", "_ref")).drop("_ref")
    if not keys:
        return pairs.select(*carry, "ref_idx")
    at = F.col("ref_idx")
    pl, tl = F.col("_h.pl"), F.col("_h.tl")[at]
    for k in keys:
        if k == "rouge2":
            pairs = _prf(pairs, F.col("_h.rouge2")[at], F.greatest(pl - 1, F.lit(0)), F.greatest(tl - 1, F.lit(0)), k)
        else:
            pairs = _prf(pairs, F.col(f"_h.{k}")[at], pl, tl, k)
    return pairs.select(*carry, "ref_idx", *_rouge_cols(keys))


def _rouge_cols(keys) -> list[str]:
    return [f"{k}_{m}" for k in keys for m in ("fmeasure", "precision", "recall")]


def rouge(df: DataFrame, pred: str = PRED, refs: str = REFS, keys=ROUGE_KEYS, by=None) -> DataFrame:
    """Unweighted mean of per-pair P/R/F over all 3N pairs."""
    b = _by(by)
    pairs = rouge_pairs(_inputs(df, b, pred, refs), pred, refs, keys, carry=b)
    return pairs.groupBy(*b).agg(*[F.avg(c).alias(c) for c in _rouge_cols(keys)])


# ---- F11 / F12 ----------------------------------------------------------------

def generation_scores(df: DataFrame, pred: str = PRED, refs: str = REFS, by=None, n_max: int = 3,
                      rouge_keys=ROUGE_KEYS) -> DataFrame:
    """BLEU, chrF++ and ROUGE in ONE scan and ONE aggregation (wide form).

    Row-level statistics (BLEU, chrF) ride on the ``ref_idx = 0`` pair so the
    single aggregate serves both corpus-level and pair-level metrics.
    """
    b = _by(by)
    keys = tuple(rouge_keys)
    rows = _inputs(df, b, pred, refs).withColumn("_h", stats_udf(n_max, True, keys)(F.col(pred), F.col(refs)))
    rows = _bleu_cols(rows, n_max)
    row_cols = ["bleu_c", "bleu_r"] + [f"bleu_{x}_{k}" for k in range(1, n_max + 1) for x in ("num", "den")]
    chrf_cols = [F.col("_h")[part].alias(f"_{part}") for part in ("match", "hyp", "ref")]
    pairs = _pairs(rows, refs, keys, carry=[*b, *row_cols, *chrf_cols])
    first = F.col("ref_idx") == 0
    aggs = [F.sum(F.when(first, F.col(c)).otherwise(0)).alias(c) for c in row_cols]
    for part in ("match", "hyp", "ref"):
        aggs += [F.sum(F.when(first, F.col(f"_{part}")[o]).otherwise(0)).alias(f"chrf_{part}_{o}")
                 for o in range(N_ORDERS)]
    aggs += [F.avg(c).alias(c) for c in _rouge_cols(rouge_keys)]
    agg = pairs.groupBy(*b).agg(*aggs)
    return agg.select(*b, _bleu_formula(n_max).alias("blue"), _chrf_formula().alias("chrf"),
                      *_rouge_cols(rouge_keys))


def to_long(df: DataFrame, keys: Sequence[str], metric_names: dict[str, str]) -> DataFrame:
    """Unpivot wide metric columns to ``(keys…, metric, value)``."""
    return df.unpivot(list(keys), list(metric_names), "metric", "value").select(
        *keys, F.element_at(F.create_map(*[x for k, v in metric_names.items() for x in (F.lit(k), F.lit(v))]),
                            F.col("metric")).alias("metric"),
        F.col("value").cast("double").alias("value"))


def report_names(rouge_keys=ROUGE_KEYS) -> dict[str, str]:
    names = {"blue": "test/blue", "chrf": "test/chrf"}
    names.update({c: f"test/rouge/{c}" for c in _rouge_cols(rouge_keys)})
    return names


def scaled_report(df: DataFrame, pred: str = PRED, refs: str = REFS, by=None) -> DataFrame:
    """ROUGE F-measures ×100 rounded to 4 places, plus mean generated length."""
    b = _by(by)
    pairs = rouge_pairs(_inputs(df, b, pred, refs).withColumn("_len", F.size(tokens(pred))), pred, refs,
                        ROUGE_KEYS, carry=b + ["_len"])
    agg = pairs.groupBy(*b).agg(
        *[F.round(F.avg(f"{k}_fmeasure") * 100, 4).alias(k) for k in ROUGE_KEYS],
        F.round(F.sum(F.when(F.col("ref_idx") == 0, F.col("_len"))) /
                F.sum(F.when(F.col("ref_idx") == 0, 1)), 4).alias("gen_len"))
    return agg.unpivot(b, list(ROUGE_KEYS) + ["gen_len"], "metric", "value")
