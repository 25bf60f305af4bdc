"""Token-probability source and perplexity.

F10 stands in for model log-probabilities: a count-based bigram LM with
add-one smoothing, fitted on the train split and scored on test. Counting is
two hash aggregates. Scoring looks counts up in two tiers: the commonest bigrams
and contexts (``HOT`` of each, of bounded length, so a bounded broadcast) meet the
rows where they lie, and only rows of rarer ones are shuffled, by (prev, cur) and
by prev. So neither ``<s>`` nor a frequent word is ever a shuffle key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import tokens
from glossa.operators.labels import nll_expr
from glossa.session import stored

BOS = "<s>"  # fixed value: sentence-start token of the bigram model


def bigram_rows(df: DataFrame, text: str, keys=("row_id",)) -> DataFrame:
    """``(keys…, step, prev, cur)`` with step 1-based over the tokens after BOS."""
    t = F.concat(F.array(F.lit(BOS)), tokens(text))
    z = df.select(*keys, t.alias("_t")).select(
        *keys, F.posexplode(F.arrays_zip(F.slice("_t", 1, F.size("_t") - 1).alias("prev"),
                                         F.slice("_t", 2, F.size("_t") - 1).alias("cur"))).alias("_i", "_z"))
    return z.select(*keys, (F.col("_i") + 1).alias("step"), F.col("_z.prev").alias("prev"),
                    F.col("_z.cur").alias("cur"))


HOT, HOT_BYTES = 50_000, 128  # entries of a broadcast tier, and their longest text: at most about 10 MB


@dataclass
class BigramLM:
    bigrams: DataFrame   # prev, cur, c, c_prev
    contexts: DataFrame  # prev, c_prev
    hot_bigrams: DataFrame
    hot_contexts: DataFrame
    vocab_size: int      # distinct observed tokens + 1 (unseen)


def _hottest(counts: DataFrame, count: str, *texts: str, n: int) -> DataFrame:
    """The ``n`` rows of the highest ``count`` among those of bounded length."""
    size = sum((F.octet_length(t) for t in texts), F.lit(0))
    return counts.filter(size <= HOT_BYTES).orderBy(F.desc(count), *texts).limit(n)


def fit_bigram(df: DataFrame, text: str, hot: int = HOT) -> BigramLM:
    """Counted once: bigrams (each with its context's count) and contexts are written to the shared folder, and the
    vocabulary size, the hot tiers and every scoring pass read them from there."""
    rows = bigram_rows(df, text, keys=())
    big = stored(rows.groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("c")), "bigrams")
    ctx = stored(big.groupBy("prev").agg(F.sum("c").alias("c_prev")), "contexts")
    top = stored(_hottest(ctx, "c_prev", "prev", n=hot), "hot-contexts")
    # a context's bigrams are distinct words, so joining by context is no more skewed than the vocabulary is long
    whole = stored(_with_contexts(big, ctx, top), "bigrams-in-context")
    v = big.agg(F.countDistinct("cur").alias("v")).first()["v"] + 1  # one scalar, not rows
    return BigramLM(whole, ctx, stored(_hottest(whole, "c", "prev", "cur", n=hot), "hot-bigrams"), top, int(v))


def _with_contexts(rows: DataFrame, contexts: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the count of their context ``prev`` (null: unseen): hot contexts by broadcast, others by a join."""
    near = rows.join(F.broadcast(hot), "prev", "left")
    known = near.filter(F.col("c_prev").isNotNull())
    return known.unionByName(near.filter(F.col("c_prev").isNull()).drop("c_prev").join(contexts, "prev", "left"))


def score_bigram(df: DataFrame, text: str, lm: BigramLM, keys=("row_id",)) -> DataFrame:
    """``(keys…, step, token, logprob)`` with ln((c(prev,cur)+1) / (c(prev)+V))."""
    near = bigram_rows(df, text, keys).join(F.broadcast(lm.hot_bigrams), ["prev", "cur"], "left")
    known = near.filter(F.col("c").isNotNull())
    rest = near.filter(F.col("c").isNull()).drop("c", "c_prev").join(lm.bigrams, ["prev", "cur"], "left")
    seen = rest.filter(F.col("c").isNotNull())
    unseen = _with_contexts(rest.filter(F.col("c").isNull()).drop("c_prev"), lm.contexts, lm.hot_contexts)
    j = known.unionByName(seen).unionByName(unseen.select(*known.columns))
    lp = F.log((F.coalesce(F.col("c"), F.lit(0)) + 1) / (F.coalesce(F.col("c_prev"), F.lit(0)) + lm.vocab_size))
    return j.select(*keys, "step", F.col("cur").alias("token"), lp.alias("logprob"))


def score_bigram_pair(df: DataFrame, a: str, b: str, lm: BigramLM, keys=("row_id",)) -> DataFrame:
    """``(keys…, step, lp_a, lp_b)`` of two texts of a row, up to the shorter one's length: both are scored
    in one tagged pass and meet again by (keys, step)."""
    tagged = df.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("_side"), F.col(a).alias("_text")),
                                                F.struct(F.lit(1).alias("_side"), F.col(b).alias("_text")))).alias("_e"))
    rows = tagged.select(*keys, "_e._side", "_e._text")
    lp = score_bigram(rows, "_text", lm, (*keys, "_side"))
    side = [F.max(F.when(F.col("_side") == i, F.col("logprob"))).alias(n) for i, n in ((0, "lp_a"), (1, "lp_b"))]
    return lp.groupBy(*keys, "step").agg(*side).filter("lp_a IS NOT NULL AND lp_b IS NOT NULL")


def perplexity(df: DataFrame, logprob: str = "logprob", label: str | None = None, by=()) -> DataFrame:
    """F8: exp(mean NLL) over tokens whose label is not -100 (corpus level)."""
    d = df if label is None else df.filter(F.col(label) != -100)
    return d.groupBy(*by).agg(F.exp(-F.avg(logprob)).alias("perplexity"))


def perplexity_from_logits(df: DataFrame, logits: str = "logits", label: str = "token_label", by=()) -> DataFrame:
    d = df.filter(F.col(label) != -100)
    return d.groupBy(*by).agg(F.exp(F.avg(nll_expr(logits, label))).alias("perplexity"))
