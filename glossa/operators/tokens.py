"""Token operators (C1–C6, C9, C10, C13), re-aimed from a pretrained sub-word
tokenizer to a corpus vocabulary DataFrame.

Special ids (fixed values): pad 0, eos 1, unk 2; ordinary ids start at 3.
Label ignore index -100.

The vocabulary has at most ``max_size`` rows by construction (a top-k); it is counted once and stored. A token's
length is unbounded, so the vocabulary's byte size is measured, and it is broadcast only when that fits the
budget. Then encoding and decoding are per-row lookups in the broadcast table (one Arrow UDF call per batch: no
explode, no shuffle of the tokens). Beyond the budget each chunk of ``CHUNK_ROWS`` rows gets a dictionary of its
own: only its distinct tokens are shuffled to the vocabulary, and their ids meet the chunk's rows again.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions import seqstats
from glossa.functions.text import tokens  # noqa: F401  (re-exported)
from glossa.session import cut_lineage, stored

PAD, EOS, UNK, FIRST_ID, IGNORE = 0, 1, 2, 3, -100
SPECIAL_IDS = (PAD, EOS, UNK)
# Measured vocabulary bytes (tokens + 16 per entry) above which it is joined, not broadcast. Every
# Python worker holds its own dict copy (~3-4x the bytes), one worker per core: 16 MB keeps that
# under about 0.5 GB per 8-core executor; a 32k-entry vocabulary is about 1 MB.
BROADCAST_BUDGET = 16 << 20
CHUNK_ROWS = 1024  # rows that share a dictionary beyond the budget
SLICE_TEXTS = 256  # texts that are strings in Python at a time


def build_vocab(df: DataFrame, cols: Sequence[str], max_size: int = 32000) -> DataFrame:
    """``(token, id)`` ranked by (count desc, token asc), ids from 3. Counted here, once, and stored: whatever
    measures, gathers or joins the vocabulary reads its few rows."""
    toks = df.select(F.explode(F.flatten(F.array(*[tokens(c) for c in cols]))).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc("token")).limit(max_size)  # TakeOrdered: k rows
    # ranking over at most max_size rows (the limit's single output partition)
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return stored(top.select("token", (F.row_number().over(w) + (FIRST_ID - 1)).cast("int").alias("id")), "vocabulary")


def vocab_table(vocab: DataFrame, budget: int | None = None) -> dict | None:
    """``{token: id}`` when the vocabulary's measured size fits ``budget``, else None. The size is
    summed first, so the entries are gathered only when they fit."""
    budget = BROADCAST_BUDGET if budget is None else budget
    nbytes = vocab.agg(F.coalesce(F.sum(F.octet_length("token") + 16), F.lit(0)).alias("b")).first()["b"]
    return None if nbytes > budget else {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}


def numbered(df: DataFrame, *cols) -> DataFrame:
    """``cols`` with a unique ``_rid`` per row, written to the checkpoint folder so that a recomputed
    task can't number its rows anew. Regrouping by it keeps rows with equal keys apart."""
    return cut_lineage(df.select(*cols, F.monotonically_increasing_id().alias("_rid")))


def chunk_entries(rows: DataFrame, lists: Column, vocab: DataFrame, key: str) -> DataFrame:
    """``(_chunk, key, value)``: the vocabulary entries that a chunk of ``rows`` (numbered) needs, each once. Repeats
    within a task go before the shuffle, so a token costs one row a chunk at most, however often it occurs."""
    value = next(c for c in ("id", "token") if c != key)
    needed = rows.select(_chunk().alias("_chunk"), F.explode(F.array_distinct(F.flatten(lists))).alias(key)).distinct()
    return needed.join(vocab.select(key, value), key).select("_chunk", F.col(key).alias("key"), F.col(value).alias("value"))


def _chunk() -> Column:
    return F.expr(f"_rid div {CHUNK_ROWS}")  # rows of one task only: a task's numbers start at a multiple of 2^33


def by_dictionary(rows: DataFrame, lists: Column, vocab: DataFrame, key: str, kept: Sequence[str], default,
                  out_type: str) -> DataFrame:
    """``kept`` columns of ``rows`` (numbered) and ``_lists``: the arrays of keys of ``lists`` (an array of arrays) with
    each key replaced by its vocabulary value, or ``default``; without a default unknown keys are left out."""
    entries = chunk_entries(rows, lists, vocab, key)
    whole = rows.select(*kept, lists.alias("_lists"), _chunk().alias("_chunk"))
    fields = ", ".join(f"`{c}` {dict(whole.dtypes)[c]}" for c in kept)
    names = [*kept, "_lists"]

    def replace(left: pa.Table, right: pa.Table) -> pa.Table:
        table = dict(zip(right["key"].to_pylist(), right["value"].to_pylist()))
        if default is None:
            new = [[[table[k] for k in ks if k in table] for ks in row] for row in left["_lists"].to_pylist()]
        else:
            new = [[[table.get(k, default) for k in ks] for ks in row] for row in left["_lists"].to_pylist()]
        kind = pa.string() if out_type == "string" else pa.int32()
        return pa.table([*[left[c] for c in kept], pa.array(new, pa.list_(pa.list_(kind)))], names=names)

    return whole.groupBy("_chunk").cogroup(entries.groupBy("_chunk")).applyInArrow(
        replace, f"{fields}, _lists array<array<{out_type}>>")


def token_ids(spark, table: dict, texts: Sequence[Column]) -> Column:
    """``array<array<int>>``: the ids of the whitespace tokens of each text (OOV → unk), no eos.
    The texts cross Arrow as strings and are tokenised in Python exactly as ``tokens`` does."""
    bc, per_row = spark.sparkContext.broadcast(table), len(texts)

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def lookup(rows: pa.Array) -> pa.Array:
        lists = ids_of(rows.flatten(), bc.value)
        return pa.ListArray.from_arrays(pa.array(range(0, len(lists) + 1, per_row), pa.int32()), lists)
    return lookup(F.array(*texts))


def ids_of(texts: pa.Array, table: dict) -> pa.ListArray:
    """The ids of the tokens of each text (null: none), as a flat array of four bytes an id: only ``SLICE_TEXTS`` texts
    and one text's tokens are Python objects at a time."""
    ids, ends = array("i"), array("i", [0])
    for start in range(0, len(texts), SLICE_TEXTS):
        for text in texts.slice(start, SLICE_TEXTS).to_pylist():
            ids.extend([table.get(t, UNK) for t in seqstats.ws_tokens(text)])
            ends.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(ids, np.int32)))


def truncate(ids, n: int) -> Column:
    """Keep at most n ids, the last kept one being eos."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.when(F.size(c) > n, F.concat(F.slice(c, 1, n - 1), F.array(F.lit(EOS)))).otherwise(c)


def pad_fixed(ids, n: int, value: int = PAD) -> Column:
    """C4: right-pad to length n (never cuts)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(c, F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(c), F.lit(0))))


def attention_mask(ids) -> Column:
    """1 for real tokens, 0 for pad."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda x: F.when(x == PAD, 0).otherwise(1))


def mask_labels(ids) -> Column:
    """Pad → -100 (ignored by the loss)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda x: F.when(x == PAD, IGNORE).otherwise(x))


def unmask_labels(ids) -> Column:
    """-100 → pad (before decoding)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda x: F.when(x == IGNORE, PAD).otherwise(x))


def shift_right(ids) -> Column:
    """Decoder input = [pad] + ids[:-1], with -100 replaced by pad."""
    c = unmask_labels(ids)
    return F.when(F.size(c) == 0, c).otherwise(F.concat(F.array(F.lit(PAD)), F.slice(c, 1, F.size(c) - 1)))


def encode(df: DataFrame, col: str, vocab: DataFrame, max_len: int, key: str = "row_id",
           out: str | None = None, table: dict | None = None) -> DataFrame:
    """C2 (+C3): ids of the whitespace tokens of ``col`` (OOV → unk), eos
    appended, truncated to ``max_len`` with eos kept. Returns ``(key, out)``,
    one row per input row (rows with equal keys stay apart).

    Plan: lookup in the broadcast vocabulary, in-stage (no shuffle), when its
    measured size fits (``table``: one measured before); else a dictionary per
    chunk of rows. Both plans return the same rows.
    """
    out = out or f"{col}_ids"
    table = vocab_table(vocab) if table is None else table
    if table is not None:
        ids = F.concat(token_ids(df.sparkSession, table, [F.col(col)])[0], F.array(F.lit(EOS)))
        return df.select(key, truncate(ids, max_len).alias(out))
    rows = numbered(df, F.col(key).alias("_key"), F.col(col).alias("_text"))
    found = by_dictionary(rows, F.array(F.coalesce(tokens("_text"), F.array().cast("array<string>"))), vocab, "token",
                          ["_key"], UNK, "int")
    ids = F.concat(F.col("_lists")[0], F.array(F.lit(EOS)))
    return found.select(F.col("_key").alias(key), truncate(ids, max_len).alias(out))


def decode(df: DataFrame, col: str, vocab: DataFrame, key: str = "row_id", out: str | None = None,
           table: dict | None = None) -> DataFrame:
    """Ids → text joined by spaces, skipping special ids (pad, eos, unk)
    and ids outside the vocabulary. Same plan choice as ``encode``."""
    out = out or f"{col}_text"
    table = vocab_table(vocab) if table is None else table
    if table is not None:
        bc = df.sparkSession.sparkContext.broadcast({i: t for t, i in table.items()})

        @F.pandas_udf(T.StringType())
        def text_of(rows: pd.Series) -> pd.Series:
            get = bc.value.get  # unknown ids are skipped, as array_join skips nulls
            return pd.Series([" ".join(t for t in map(get, ids) if t is not None) if ids is not None else ""
                              for ids in rows], dtype=object)
        kept = F.filter(unmask_labels(col), lambda x: ~x.isin(*SPECIAL_IDS))
        return df.select(key, text_of(kept).alias(out))
    kept = F.filter(unmask_labels(col), lambda x: ~x.isin(*SPECIAL_IDS))
    rows = numbered(df, F.col(key).alias("_key"), F.coalesce(kept, F.array().cast("array<int>")).alias("_ids"))
    found = by_dictionary(rows, F.array("_ids"), vocab, "id", ["_key"], None, "string")
    return found.select(F.col("_key").alias(key), F.array_join(F.col("_lists")[0], " ").alias(out))


def gen_len(df: DataFrame, col: str, by=()) -> DataFrame:
    """Mean count of non-pad ids, rounded to 4 places."""
    return df.groupBy(*by).agg(F.round(F.avg(F.size(F.filter(col, lambda x: x != PAD))), 4).alias("gen_len"))
