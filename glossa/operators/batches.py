"""Batch operators (B8, C7, C8, C11, C12, C14) and the preparation pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import MAX_SOURCE_LEN, MAX_TARGET_LEN
from glossa.operators import prep, tokens as TK
from glossa.operators.rowindex import OrderedTable, dense_index


def assign_batches(df: DataFrame, order: list, size: int, name: str = "batch_id",
                   index: str = "row_idx") -> DataFrame:
    """Stable fixed-size batches in ``order`` (dataset order for evaluation)."""
    idx = dense_index(df, order, index)
    return idx.withColumn(name, F.floor(F.col(index) / size).cast("bigint"))


def shuffle_order(df: DataFrame, key: str, seed: int, name: str = "shuffle_idx") -> DataFrame:
    """C11: reproducible shuffle = dense index over md5(key ‖ seed) (key breaks ties)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return dense_index(df.withColumn("_h", h), ["_h", key], name).drop("_h")


def limit_batches(df: DataFrame, k: int | None, batch: str = "batch_id") -> DataFrame:
    """First k batches (None = all), a filter on the assigned number."""
    return df if k is None else df.filter(F.col(batch) < k)


def first_batches(table: OrderedTable, k: int, size: int, batch: str = "batch_id") -> DataFrame:
    """C12 on a table stored in order: the first k batches of ``size`` rows, from the files that hold them."""
    return table.between(0, k * size - 1).withColumn(batch, F.floor(F.col(table.name) / size).cast("bigint"))


def collate(df: DataFrame, batch: str = "batch_id", ids: str = "input_ids", mask: str = "attention_mask",
            labels: str = "labels") -> DataFrame:
    """Pad ids/mask to the longest in the batch with 0, labels with -100.
    The window partition is one batch (bounded by the batch size)."""
    w = Window.partitionBy(batch)
    out = df.withColumn("_li", F.max(F.size(ids)).over(w))
    out = out.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(TK.PAD), F.col("_li") - F.size(ids))))
    out = out.withColumn(mask, F.concat(F.col(mask), F.array_repeat(F.lit(0), F.col("_li") - F.size(mask))))
    if labels in df.columns:
        out = out.withColumn("_ll", F.max(F.size(labels)).over(w)).withColumn(
            labels, F.concat(F.col(labels), F.array_repeat(F.lit(TK.IGNORE), F.col("_ll") - F.size(labels))))
    return out.drop("_li", "_ll")


def batch_shapes(df: DataFrame, batch: str = "batch_id", ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """C14: rows × padded widths per batch."""
    return df.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(ids)).alias("input_width"),
                                 F.max(F.size(labels)).alias("label_width"))


def prepare(nli: DataFrame, vocab: DataFrame, style: str = "canonical", max_source: int = MAX_SOURCE_LEN,
            max_target: int = MAX_TARGET_LEN) -> DataFrame:
    """B8 (+B5, C2–C5): processed rows. Every split gets ``input_ids``,
    ``attention_mask``, ``int_labels`` and ``labels`` (explanation 1); the
    validation/test splits also get ``explanation_1..3`` padded to 128 with 0
    (train rows carry nulls there).

    The four texts of a row are encoded together: one lookup in the broadcast
    vocabulary when its measured size fits (in-stage, no shuffle); else a
    dictionary per chunk of rows, with the same rows as result (rows with equal
    ``row_id`` stay apart)."""
    texts = [prep.input_text(style=style), F.col("explanation_1"), F.col("explanation_2"), F.col("explanation_3")]
    table = TK.vocab_table(vocab)
    if table is not None:
        per_row = nli.select("row_id", "split", "label", TK.token_ids(nli.sparkSession, table, texts).alias("_f"))
    else:
        rows = TK.numbered(nli, "row_id", "split", "label", F.array(*texts).alias("_texts"))
        lists = F.transform("_texts", lambda t: F.coalesce(TK.tokens(t), F.array().cast("array<string>")))
        per_row = TK.by_dictionary(rows, lists, vocab, "token", ["row_id", "split", "label"], TK.UNK, "int") \
            .withColumnRenamed("_lists", "_f")

    def own(i: int):
        return F.col("_f")[i]

    def ids(i: int, n: int):
        return TK.truncate(F.concat(own(i), F.array(F.lit(TK.EOS))), n)

    enc = per_row.select("row_id", "split", "label", ids(0, max_source).alias("input_ids"),
                         *[ids(i, max_target).alias(f"_e{i}") for i in (1, 2, 3)])
    is_train = F.col("split") == "train"
    return enc.select(
        "row_id", "split", "input_ids", TK.attention_mask("input_ids").alias("attention_mask"),
        F.col("label").alias("int_labels"), F.col("_e1").alias("labels"),
        *[F.when(~is_train, TK.pad_fixed(f"_e{i}", max_target)).alias(f"explanation_{i}") for i in (1, 2, 3)])
