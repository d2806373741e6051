"""The thin queries of the operators, as the contracts name their columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytestrata.llm import bpe, cover_tree, fingerprints, licenses, mixing, ngram_join, quality, secrets, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_files(table(spark, sf_dir, "documents")))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.linked(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mixing": op1_mixing, "op2_fingerprints": op2_fingerprints, "op3_suffix_dedup": op3_suffix_dedup, "op4_secrets": op4_secrets, "op5_quality": op5_quality, "op6_bpe": op6_bpe,
    "op7_licenses": op7_licenses, "op8_ngram_join": op8_ngram_join, "op9_toxicity": op9_toxicity, "op10_cover_tree": op10_cover_tree,
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op8_ngram_join": ngram_join.ORACLE, "op10_cover_tree": cover_tree.ORACLE}
