"""The corpus pipeline: five stages over documents, each of one operator.

Toxic documents go; of similar ones one stays; secrets are blotted out; sources are mixed to their target weights
in training order; what is left is encoded. Every stage works on all that the stage before it kept. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bytestrata.llm import bpe, mixing, ngram_join, secrets, toxicity
from bytestrata.llm.common import cut, discard, pick

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned from the labels, does not reject."""
    return toxicity.clean(pick(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are linked by a similarity of 0.8 or more."""
    return ngram_join.one_of_each(pick(docs, *COLUMNS))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark."""
    return secrets.redact(pick(docs, *COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.training_order(pick(docs, *COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.encode(docs, path, public_tokenizers.PATTERN, ("doc_id", "source"))
    return found.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", not_toxic), ("near_duplicates", near_duplicates), ("secrets", no_secrets), ("mixing", mixed), ("tokens", tokens)]

#: A learned classifier decides in the first stage, so SQL cannot express the rows; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of a folder; what each stage keeps is written before the next one reads it."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
