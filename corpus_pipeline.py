"""Corpus pipeline: five stages applied in order to ``documents``, each written as Parquet and read again.

1. ``language`` (operator 1): rows in no learned language go (no letters, or code lengths near those of random bytes).
2. ``quality`` (operator 6): rows that importance resampling does not select go.
3. ``near_duplicates`` (operator 8): of each group of near duplicates the row with the smallest doc_id stays.
4. ``pii`` (operator 9): spans of personal data are masked in the text; ``n_chars`` follows.
5. ``packing`` (operator 7): pieces of the documents are packed into training windows, one row per piece.

Every stage works on all rows its predecessor kept and fits its statistics on them; all but the last return the columns
of ``documents``. Models are learned from the labels of the input folder and from the stage's own documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import ngram_join, packing, pii, ppm, resample
from glossa.session import ensure_checkpoint_dir, shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ppm.keep_language(docs, ppm.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = resample.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    _, cut = resample.resample(docs, model)
    return resample.select_rows(docs, model, cut)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.text_items(docs))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("pii", mask_pii),
          ("packing", pack_windows)]

#: Trained models, similarity joins and best-fit search are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole corpus."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
