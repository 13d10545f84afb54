"""One query for each operator of this subpackage, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, compression, fixity, langid, licenses, lm, spaced_seeds, token_counts, urls
from .common import crc32_mod, table

#: Fixed values: (verdict, host, path) of the rules that come before the trees.
URL_RULES: list[urls.Rule] = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BPE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_bands(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op3_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id with its class (the least doc_id of its near-duplicates) and the number of rows in it."""
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def replica(pages: DataFrame) -> DataFrame:
    """A copy of pages with faults that depend on the id: some bodies altered, some records lost."""
    fault = crc32_mod(F.col("page_id"), 97)
    body = F.when(fault == 5, F.concat(F.lit("!"), F.col("html"))).otherwise(F.col("html"))
    return pages.where((fault != 11) | F.col("page_id").isNull()).select("page_id", "url", body.alias("html"))


def op5_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return fixity.audit(pages, replica(pages))


def files_of(docs: DataFrame) -> DataFrame:
    """documents as a tree of files, source/language/thousand/id; one whose first line names a licence gives it to its folder."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    path = F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none")), part("doc_id"))
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return docs.select("doc_id", path.alias("path"), "text", first.rlike(licenses.CUE).alias("is_licence_file"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(files_of(table(spark, sf_dir, "documents")), key="doc_id", licence_file=F.col("is_licence_file"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    model = langid.learn(docs.where(~held_out))
    flags = docs.select("text", F.struct("doc_id", held_out.alias("held_out")).alias("k"))
    return langid.predicted(flags, model, key="k").select("k.doc_id", "k.held_out", "lang_pred", "score", "rejected")


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps of documents with benchmark items; documents without one have no row."""
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.scores(docs, crc32_mod(F.col("doc_id"), 7) == 2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECE_FILE))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_compression_bands, op2_url_filter, op3_tree_bpe, op4_bagminhash, op5_merkle_fixity, op6_license_scan, op7_language_id, op8_spaced_seeds, op9_gru_scores, op10_token_counts, pipeline)
}

#: Trees, tokenizers, signatures, centroids and language models have no SQL form; their tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
