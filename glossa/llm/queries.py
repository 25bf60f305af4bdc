"""The ``opN_<name>`` queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import licenses, merkle, negatives

RANKS = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import ppm
    docs = _documents(spark, sf_dir)
    held = ppm.held_out(4, 2)
    return ppm.predict(docs, ppm.train(docs.filter(~held)), held)


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = licenses.known_digests(licenses.builtin_texts(spark))
    return licenses.scan(_documents(spark, sf_dir), known)


def op3_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import iblt
    return iblt.fingerprints(_documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from glossa.llm import bpe
    return bpe.round_trip_digests(_documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_qalsh_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import qalsh
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return qalsh.nearest(vectors, F.col("vec_id") % 20 == 0, 20)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import resample
    docs = _documents(spark, sf_dir)
    model = resample.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return resample.resample(docs, model)[0].drop("key_bits", "tie")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import packing
    return packing.pack(packing.near_duplicate_items(_documents(spark, sf_dir)))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import ngram_join
    return ngram_join.near_duplicates(_documents(spark, sf_dir))


def op9_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import pii
    docs = _documents(spark, sf_dir)
    return pii.find_pii(docs, pii.train(docs))


def op10_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import toxicity
    from glossa.llm.ppm import held_out
    docs = _documents(spark, sf_dir)
    held = held_out(3, 1)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs.select("doc_id", "text"), labels.filter(~held))
    return toxicity.score(docs, machine, held)


def op11_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_documents(spark, sf_dir), merkle.without_line_feeds())


def op13_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.llm import lineblocks
    return lineblocks.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_ppm_language, op2_license_digests, op3_iblt_fingerprints, op4_byte_bpe, op5_qalsh_neighbours,
    op6_importance_resampling, op7_best_fit_packing, op8_ngram_jaccard_join, op9_skip_chain_pii, op10_string_kernel_toxicity,
    op11_slot_negatives, op12_merkle_manifest, op13_line_block_text)}
ORACLE_SQL: dict[str, str] = {
    "op2_license_digests": licenses.oracle_sql(), "op11_slot_negatives": negatives.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql()}
