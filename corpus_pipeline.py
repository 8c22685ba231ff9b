"""A corpus from raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm import decontaminate, minhash, pii, tokens, toxicity
from shelfspan.llm.common import materialize, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from `labels` of the given documents. Null and empty texts get the score of the bias and mostly stay; repeated rows all go or all stay; an empty table gives an empty one."""
    small_batches(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id, null last, then the least text digest. Null and empty texts are copies of each other; an empty table gives an empty one."""
    small_batches(spark)
    return minhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null and empty texts hold none and stay; repeated rows all go or all stay; an empty table gives an empty one."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars counted anew. A null text stays null with null n_chars; all rows stay, in whatever order."""
    small_batches(spark)
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, n_tokens and whether decoding gives the text back. A null text has no ids and comes back as the empty text; all rows stay."""
    small_batches(spark)
    got = tokens.encode(docs, tokens.vocabulary(), round_trip="round_trip")
    return got.select(*docs.columns, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

#: Learned scores, hashed signatures and merges aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
