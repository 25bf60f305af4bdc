"""Native n-gram expressions (F1) and the BLEU closest reference length.

A gram is the space-joined token window (tokens never contain spaces). Clipped
overlaps are counted per text with hashed counters (``functions.seqstats``),
which stay linear on whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _empty() -> Column:
    return F.array().cast("array<string>")


def word_ngrams(toks: Column, n: int) -> Column:
    """Token windows of length n; [] when fewer than n tokens (guards sequence(1, 0))."""
    if n == 1:
        return toks
    return F.when(
        F.size(toks) >= n,
        F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " ")),
    ).otherwise(_empty())


def closest_length(pred_len: Column, ref_lens: Column) -> Column:
    """Length of the reference closest to pred_len; the first listed wins a tie."""
    init = F.struct(F.lit(None).cast("int").alias("d"), F.lit(0).alias("len"))
    best = F.aggregate(
        ref_lens, init,
        lambda acc, x: F.when(acc["d"].isNull() | (F.abs(x - pred_len) < acc["d"]),
                              F.struct(F.abs(x - pred_len).alias("d"), x.alias("len"))).otherwise(acc))
    return best["len"]
