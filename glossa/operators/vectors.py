"""Vector operators: greedy-match similarity (F7) and masked mean pooling.

F7 never gathers a whole pair: both sides' tokens are grouped into blocks of at
most ``block`` vectors, each block meets each block of the other side once (one
matrix product a row), and the best cosine per token is a max over blocks. A
hot pair with a third of all tokens is spread over many rows and tasks (AQE
splits the skewed join partition). J2 uses MLlib's ``Summarizer`` so pooling is a partial
(map-side) aggregate and no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BEST = T.StructType([T.StructField("pred", T.ArrayType(T.DoubleType())), T.StructField("ref", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(_BEST)
def block_best_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Best cosine of each vector of one block to the other block, both ways: one matrix product per row.
    A zero vector has cosine 0 to everything."""
    def unit(block) -> np.ndarray:
        m = np.stack([np.asarray(x, dtype=np.float64) for x in block])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1.0)
    rows = []
    for p, r in zip(pred, ref):
        cos = unit(p) @ unit(r).T
        rows.append((cos.max(axis=1), cos.max(axis=0)))
    return pd.DataFrame({"pred": [a for a, _ in rows], "ref": [b for _, b in rows]})


def greedy_match_pairs(df: DataFrame, pair: str | Sequence[str] = "pair_id", side: str = "side", pos: str = "pos",
                       vec: str = "vec", mask: str = "mask", block: int = 64) -> DataFrame:
    """Per pair: P = mean over pred tokens of the best cosine to a ref token,
    R symmetric, F = 2PR/(P+R). Masked (padding) tokens take no part; a pair
    without tokens on one side scores 0, as empty texts do in ROUGE. ``pair`` may
    be several columns (say system, input and reference index).

    Both sides are cut into blocks of at most ``block`` vectors and each block
    meets each block of the other side once: one matrix product answers both
    directions, and a hot pair spreads over many rows and tasks."""
    keys = [pair] if isinstance(pair, str) else list(pair)
    toks = df.filter(F.col(mask) == 1).select(*keys, F.col(side).alias("_side"), F.col(pos).alias("_pos"),
                                             F.floor(F.col(pos) / block).alias("_blk"), F.col(vec).alias("_vec"))
    blocks = toks.groupBy(*keys, "_side", "_blk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_vec"))), lambda t: t["_vec"]).alias("_vecs"))
    p = blocks.filter(F.col("_side") == "pred").select(*keys, F.col("_blk").alias("_pb"), F.col("_vecs").alias("_pv"))
    r = blocks.filter(F.col("_side") == "ref").select(*keys, F.col("_blk").alias("_rb"), F.col("_vecs").alias("_rv"))
    met = p.join(r, keys).select(*keys, "_pb", "_rb", block_best_udf("_pv", "_rv").alias("_b"))
    per = F.explode(F.array(F.struct(F.lit("pred").alias("s"), F.col("_pb").alias("b"), F.col("_b.pred").alias("m")),
                            F.struct(F.lit("ref").alias("s"), F.col("_rb").alias("b"), F.col("_b.ref").alias("m"))))
    one = met.select(*keys, per.alias("_x")).select(*keys, "_x.s", "_x.b", F.posexplode("_x.m").alias("i", "m"))
    best = one.groupBy(*keys, "s", "b", "i").agg(F.max("m").alias("m"))
    scores = best.groupBy(*keys).agg(F.avg(F.when(F.col("s") == "pred", F.col("m"))).alias("precision"),
                                     F.avg(F.when(F.col("s") == "ref", F.col("m"))).alias("recall"))
    prec, rec = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    return df.select(*keys).distinct().join(scores, keys, "left").select(*keys, prec.alias("precision"), rec.alias("recall")) \
        .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                  F.col("precision") + F.col("recall")), F.lit(0.0)))


def greedy_match(df: DataFrame, **kw) -> DataFrame:
    """F7 + E9: mean of the per-pair scores."""
    pairs = greedy_match_pairs(df, **kw)
    return pairs.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def masked_mean_pool(df: DataFrame, keys=("pair_id", "side"), vec: str = "vec", mask: str = "mask",
                     divide_by: str = "length") -> DataFrame:
    """Σ mask·v divided by the padded length L (default, as the reference
    does) or by the mask count (``divide_by='mask'``). A fully masked sequence
    pools to zeros by length and to nulls by mask count."""
    scaled = F.transform(F.col(vec), lambda x: x.cast("double") * F.col(mask).cast("double"))
    feats = df.select(*keys, array_to_vector(scaled).alias("_v"), F.col(mask).cast("double").alias("_m"))
    agg = feats.groupBy(*keys).agg(
        Summarizer.sum(F.col("_v")).alias("_s"),
        F.count(F.lit(1)).alias("_len"), F.sum("_m").alias("_mc"))
    den = F.col("_len") if divide_by == "length" else F.col("_mc")
    return agg.select(*keys, F.transform(vector_to_array("_s"), lambda x: F.try_divide(x, den)).alias("pooled"))
