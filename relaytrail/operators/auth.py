"""Authentication-Results: what trusted infrastructure reported, and what was injected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import any_suffix, blank_to_null
from relaytrail.functions.net import last_two_labels
from relaytrail.functions.text import header_values


def _find(c: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(c, pattern, group))


def _mechanism_pairs(header: Column) -> Column:
    """(mechanism, result) in order of appearance; unknown results read as ``none``."""
    pattern = F.lit(fv.MECHANISM_PATTERN)

    def known(mechanism: Column, value: Column) -> Column:
        result = F.lower(value)
        return F.struct(
            F.lower(mechanism).alias("mechanism"),
            F.when(result.isin(*fv.AUTH_RESULTS), result).otherwise("none").alias("result"),
        )

    return F.zip_with(
        F.regexp_extract_all(header, pattern, 1), F.regexp_extract_all(header, pattern, 2), known
    )


def _aligned(mechanism: Column, header: Column, from_domain: Column) -> Column:
    """Whether the identifier a mechanism vouched for is the From domain; NULL if undecidable."""

    def same(identifier: Column) -> Column:
        return last_two_labels(F.lower(identifier)) == last_two_labels(from_domain)

    envelope = F.substring_index(_find(header, fv.MAILFROM_PATTERN), "@", -1)
    return F.when(
        from_domain != "",
        F.when(mechanism == "dkim", same(_find(header, fv.HEADER_D_PATTERN)))
        .when(mechanism == "spf", same(envelope))
        .when(mechanism == "dmarc", same(_find(header, fv.HEADER_FROM_PATTERN))),
    )


def evaluate_authentication(messages: DataFrame) -> DataFrame:
    """Add ``auth_results`` and its summary columns.

    Only the topmost header of a trusted authserv-id is believed. A pass in any other header is
    an injection, also when it names the same authserv-id. Needs ``headers``, ``from_domain``
    and ``trusted_authserv`` columns.
    """
    listed = messages.withColumn(
        "_ar",
        F.transform(
            header_values(F.col("headers"), "Authentication-Results"),
            lambda h: F.struct(
                h.alias("header"),
                F.lower(_find(h, fv.AUTHSERV_PATTERN)).alias("authserv"),
                _mechanism_pairs(h).alias("pairs"),
            ),
        ),
    )
    trusted_at = F.array_position(
        F.transform(
            "_ar",
            lambda a: F.coalesce(any_suffix(a["authserv"], F.col("trusted_authserv")), F.lit(False)),
        ),
        True,
    )
    picked = listed.withColumn("_at", trusted_at.cast("int")).withColumn(
        "_trusted", F.get("_ar", F.col("_at") - 1)
    )

    def result(p: Column) -> Column:
        header = F.col("_trusted.header")
        return F.struct(
            p["mechanism"].alias("mechanism"),
            p["result"].alias("result_reported"),
            F.col("_trusted.authserv").alias("authserv_id"),
            F.lit(True).alias("trusted_source"),
            _aligned(p["mechanism"], header, F.col("from_domain")).alias("aligned"),
            _find(header, fv.HEADER_S_PATTERN).alias("selector"),
            F.lower(_find(header, fv.HEADER_D_PATTERN)).alias("d_domain"),
            F.when(p["mechanism"] == "spf", fv.SPF_CAVEAT).alias("caveat"),
        )

    no_pairs = F.array().cast("array<struct<mechanism:string,result:string>>")
    results = F.transform(F.coalesce(F.col("_trusted.pairs"), no_pairs), result)
    untrusted = F.filter("_ar", lambda a, i: i + 1 != F.col("_at"))
    forged = F.exists(
        untrusted, lambda a: F.exists(a["pairs"], lambda p: p["result"] == "pass")
    )
    evaluated = picked.select(
        *messages.columns,
        results.alias("auth_results"),
        F.col("_trusted.authserv").alias("trusted_authserv_id"),
        (F.size("_ar") - F.when(F.col("_at") > 0, 1).otherwise(0)).alias("discarded_headers"),
        forged.alias("forged_pass_detected"),
    )
    return evaluated.withColumn(
        "dmarc_aligned",
        F.exists(
            "auth_results",
            lambda r: r["mechanism"].isin("dmarc", "dkim")
            & (r["result_reported"] == "pass")
            & F.coalesce(r["aligned"], F.lit(False)),
        ),
    )


def auth_rows(analysed: DataFrame, *keys: str) -> DataFrame:
    """One row per reported mechanism."""
    return analysed.select(*keys, F.posexplode("auth_results").alias("position", "r")).select(
        *keys, "position", "r.*"
    )


