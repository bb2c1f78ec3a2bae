"""Guards over model output: grounded quotes, known facts only, no forbidden claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import map_lookup, strings
from relaytrail.functions.text import collapse_spaces


def quote_grounded(body: Column, quote: Column) -> Column:
    """Whether a quote occurs in the body, white space and case aside; empty quotes do not."""
    return F.coalesce(
        (quote != "") & collapse_spaces(body).contains(collapse_spaces(quote)), F.lit(False)
    )


def level_score(level: Column) -> Column:
    return map_lookup(fv.LEVEL_SCORES, level)


def ground_extractions(outputs: DataFrame, bodies: DataFrame, key: str = "case_id") -> DataFrame:
    """Keep signals and claims whose quote is verbatim in the message; count both kinds.

    ``outputs``: key, signals array<struct<type,level,quote>>, impersonated_entity and
    requested_action structs with a ``quote``. ``bodies``: key, text_body.
    """
    joined = outputs.join(bodies.select(key, "text_body"), key)
    body = collapse_spaces(F.col("text_body"))

    def grounded(quote: Column) -> Column:
        return F.coalesce((quote != "") & body.contains(collapse_spaces(quote)), F.lit(False))

    kept = F.filter("signals", lambda s: grounded(s["quote"]))
    claims = [F.col("impersonated_entity"), F.col("requested_action")]
    lost_claims = sum(
        (
            F.when(c.isNotNull() & ~body.contains(collapse_spaces(c["quote"])), 1).otherwise(0)
            for c in claims
        ),
        F.lit(0),
    )
    return joined.select(
        *[c for c in outputs.columns if c not in ("signals", "impersonated_entity", "requested_action")],
        kept.alias("signals"),
        *[
            F.when(body.contains(collapse_spaces(F.col(f"{c}.quote"))), F.col(c)).alias(c)
            for c in ("impersonated_entity", "requested_action")
        ],
        F.size(kept).alias("quotes_validated"),
        (F.size("signals") - F.size(kept) + lost_claims).alias("quotes_dropped"),
    )


def redact_unknown_facts(text: Column, known: Column) -> Column:
    """struct(text, stripped): addresses, domains and hashes not among ``known`` redacted.

    ``known`` is an array of lower-cased indicator values.
    """

    def unknown(t: Column, pattern: str) -> Column:
        return F.filter(
            F.regexp_extract_all(t, F.lit(pattern), 0),
            lambda m: ~F.array_contains(known, F.lower(m)),
        )

    def redact(state: Column, pattern: str) -> Column:
        found = unknown(state["text"], pattern)
        return F.struct(
            F.aggregate(
                found, state["text"], lambda t, m: F.replace(t, m, F.lit(fv.REDACTION_TEXT))
            ).alias("text"),
            F.concat(state["stripped"], found).alias("stripped"),
        )

    state = F.struct(text.alias("text"), strings([]).alias("stripped"))
    for pattern in fv.FACT_PATTERNS:
        state = F.element_at(F.transform(F.array(state), _bound(redact, pattern)), 1)
    return state


def _bound(step, pattern: str):
    def apply(state: Column) -> Column:
        return step(state, pattern)

    return apply


def check_claims(text: Column) -> Column:
    """struct(text, violations): sentences with a forbidden claim removed, with a notice."""

    def drop(state: Column, phrase: Column) -> Column:
        kept = F.array_join(
            F.filter(
                F.split(state["text"], r"\. "), lambda s: ~F.lower(s).contains(phrase)
            ),
            ". ",
        )
        hit = F.lower(state["text"]).contains(phrase)
        return F.struct(
            F.when(hit, kept).otherwise(state["text"]).alias("text"),
            F.when(hit, F.concat(state["violations"], F.array(phrase)))
            .otherwise(state["violations"])
            .alias("violations"),
        )

    start = F.struct(text.alias("text"), strings([]).alias("violations"))
    return F.aggregate(
        strings(fv.FORBIDDEN_PHRASES),
        start,
        drop,
        lambda s: F.struct(
            F.trim(
                F.concat(
                    s["text"],
                    F.when(F.size(s["violations"]) > 0, fv.FORBIDDEN_NOTICE).otherwise(""),
                )
            ).alias("text"),
            s["violations"].alias("violations"),
        ),
    )


def checked_narrative(narratives: DataFrame) -> DataFrame:
    """Apply the claim check to ``explanation`` and keep the actions."""
    checked = narratives.withColumn("_c", check_claims(F.col("explanation")))
    return checked.select(
        *[c for c in narratives.columns if c not in ("explanation", "recommended_actions")],
        F.col("_c.text").alias("explanation"),
        "recommended_actions",
        F.col("_c.violations").alias("violations"),
    )


def grounding_ratio(analyses: DataFrame, *keys: str) -> DataFrame:
    """Dropped quotes per validated quote."""
    dropped, kept = F.sum("quotes_dropped"), F.sum("quotes_validated")
    return analyses.groupBy(*keys).agg(
        dropped.alias("quotes_dropped"),
        kept.alias("quotes_validated"),
        F.try_divide(dropped, kept).alias("dropped_ratio"),
    )
