"""From documents to token counts and digests: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import bagminhash, bpe, compression, langid, spaced_seeds
from chartloom.llm.common import crc32_mod, table, written
from chartloom.llm.queries import BPE_FILE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands."""
    return compression.kept_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of some language; learned from three quarters of the labelled ones."""
    return langid.kept_documents(docs, langid.learn(docs.where(crc32_mod(F.col("doc_id"), 4) != 2)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return bagminhash.kept_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return spaced_seeds.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of each document, and digests of the ids and the decoded text."""
    return bpe.round_trip(docs, public_tokenizers.path(BPE_FILE)).drop("n_joins")


STAGES = [("quality rules", quality), ("language id", language), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("bpe encoding", encoding)]

#: Compression ratios, centroids and signatures have no SQL form; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
