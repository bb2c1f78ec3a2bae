"""Model inputs, the response cache and records of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.canonical import canonical_json


def established_facts() -> dict[str, Column]:
    """Facts a model is told and may not contradict."""
    return {
        "from_display": F.col("from_display"),
        "reply_to_divergent": F.coalesce(
            (F.col("reply_to_address") != "") & (F.col("from_address") != "")
            & (F.col("reply_to_address") != F.col("from_address")),
            F.lit(False),
        ),
        "dmarc_aligned_to_claimed_identity": F.exists(
            "auth_results",
            lambda r: (r["mechanism"] == "dmarc") & F.coalesce(r["aligned"], F.lit(False)),
        ),
        "impersonation_rules_fired": F.array_sort(
            F.transform(
                F.filter("findings", lambda f: f["rule_id"].startswith("IDENT_")),
                lambda f: f["rule_id"],
            )
        ),
    }


def model_payloads(analysed: DataFrame, *keys: str) -> DataFrame:
    """Payload text (keys sorted) and its digest for every message."""
    facts = established_facts()
    payload = canonical_json(
        {
            "established_facts": F.struct(*[facts[k].alias(k) for k in sorted(facts)]),
            "subject": F.coalesce("subject", F.lit("")),
            "email_body": F.col("text_body"),
        }
    )
    return analysed.select(*keys, payload.alias("payload")).withColumn(
        "input_sha256", F.sha2("payload", 256)
    )


def with_cache_key(payloads: DataFrame, model: str, version: str) -> DataFrame:
    """Add the cache key: digest of model, prompt version and payload."""
    return payloads.withColumn(
        "cache_key",
        F.sha2(F.concat_ws("\u0000", F.lit(model), F.lit(version), F.col("payload")), 256),
    )


def split_by_cache(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their cached response, requests still to be answered).

    ``cache``: cache_key, response, hits. Equal requests are asked once.
    """
    hits = requests.join(cache.select("cache_key", "response"), "cache_key")
    misses = requests.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    return hits, misses


def cache_after(cache: DataFrame, requests: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache after a round: hit counts raised, new answers added if absent."""
    asked = requests.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_asked"))
    counted = cache.join(asked, "cache_key", "left").select(
        "cache_key", "response", (F.col("hits") + F.coalesce("_asked", F.lit(0))).alias("hits")
    )
    fresh = (
        answers.join(cache, "cache_key", "left_anti")
        .groupBy("cache_key")
        .agg(F.min("response").alias("response"))
        .withColumn("hits", F.lit(0).cast("long"))
    )
    return counted.unionByName(fresh)


def output_records(outputs: DataFrame, model: str, version: str) -> DataFrame:
    """Rows that say which analytic produced which output.

    ``outputs``: case_id, input_sha256, response, quotes_validated, quotes_dropped,
    prompt_injection_detected.
    """
    return outputs.select(
        "case_id",
        F.lit("extract").alias("call_kind"),
        F.lit(model).alias("model_id"),
        F.lit(version).alias("prompt_version"),
        "input_sha256",
        F.sha2("response", 256).alias("output_sha256"),
        "quotes_validated",
        "quotes_dropped",
        "prompt_injection_detected",
    )
