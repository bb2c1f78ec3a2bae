"""Texts for readers: the templated narrative and the one-line verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import map_lookup, strings


def top_finding_titles(findings: Column, n: int = 3) -> Column:
    """Titles of the ``n`` findings with the highest contribution, in report order for ties."""
    ranked = F.array_sort(
        F.transform(
            findings,
            lambda f, i: F.struct(
                (-f["score_contribution"]).alias("rank"), i.alias("at"), f["title"].alias("title")
            ),
        )
    )
    return F.transform(F.slice(ranked, 1, n), lambda r: r["title"])


def templated_narrative(analysed: DataFrame, *keys: str) -> DataFrame:
    """Deterministic explanation and actions; says whether generation would be worth it."""
    reasons = F.coalesce(
        F.nullif(F.array_join(top_finding_titles(F.col("findings")), "; "), F.lit("")),
        F.lit("no significant findings"),
    )
    score = F.col("score").cast("string")
    benign = F.col("band") == "benign"
    return analysed.select(
        *keys,
        F.when(benign, F.format_string(fv.NARRATIVE_BENIGN, score)).otherwise(
            F.format_string(
                fv.NARRATIVE_THREAT,
                F.replace("classification", F.lit("_"), F.lit(" ")), score, F.col("band"),
                reasons, F.col("origin_confidence").cast("string"),
            )
        ).alias("explanation"),
        F.when(benign, strings(fv.NARRATIVE_BENIGN_ACTIONS))
        .otherwise(strings(fv.NARRATIVE_THREAT_ACTIONS))
        .alias("recommended_actions"),
        F.when(
            F.col("score") < fv.NARRATIVE_MIN_SCORE,
            F.format_string(
                "score %d is below the generation threshold %d", F.col("score"),
                F.lit(fv.NARRATIVE_MIN_SCORE),
            ),
        ).alias("unavailable_reason"),
    )


def headline(band: Column, classification: Column) -> Column:
    label = F.coalesce(map_lookup(fv.PLAIN_LABELS, classification), F.lit("something suspicious"))
    return (
        F.when(band == "benign", fv.HEADLINE_BENIGN)
        .when(
            band.isin("critical", "high"),
            F.concat(F.lit("This looks like "), label, F.lit(". Do not act on it.")),
        )
        .otherwise(F.concat(F.lit("This may be "), label, F.lit(". Treat it with caution.")))
    )


def advice(band: Column) -> Column:
    return (
        F.when(band == "benign", fv.ADVICE_BENIGN)
        .when(band.isin("critical", "high"), fv.ADVICE_STRONG)
        .otherwise(fv.ADVICE_WEAK)
    )


def verdicts(analysed: DataFrame, *keys: str) -> DataFrame:
    """What the person who received a message is shown."""
    return analysed.select(
        *keys, "score", "band", "classification",
        headline(F.col("band"), F.col("classification")).alias("headline"),
        advice(F.col("band")).alias("advice"),
        map_lookup(fv.PLAIN_BANDS, F.col("band")).alias("band_label"),
        "origin_confidence", "feos_ip", "subject", "from_address",
    )
