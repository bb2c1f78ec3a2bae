"""From raw documents to token ids: quality rules, exact dedup, near-dedup, mixing, encoding.

Every stage takes all that the stage before kept and gives the columns of ``documents``; the last
gives token ids. ``run`` writes each stage's rows as a table in the shared folder and reads it back
for the next, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from relaytrail.llm import bpe, exact_dedup, mixing, quality, simhash
from relaytrail.llm.common import durable_table, table


#: Shares of the mixture's tokens: good documents stay whole, the other domains shrink beside them.
TARGETS = {"good": 0.96, "plain": 0.01, "toxic": 0.03}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are mostly boilerplate lines of their host."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near fingerprints stays."""
    return simhash.drop_near_duplicates(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins out over-represented domains; no document is repeated after deduplication."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), targets=TARGETS, most=1.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): packed ids of every text."""
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_dedup", near_duplicates),
    ("mixing", mixing_weights),
    ("byte_bpe", token_ids),
]

#: Mixing fits its rates step by step and BPE merges by rank: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable_table(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
