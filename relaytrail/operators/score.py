"""Findings to an explainable score.

Works on a message row that carries its findings as an array. Group scores, controls, band and
classification are expressions over that array; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import map_lookup, strings
from relaytrail.functions.similarity import saturating_fold

_IMPERSONATION = ("IDENT_PROTECTED_DISPLAY_NAME", "IDENT_LOOKALIKE_DOMAIN")
_TOTAL_WEIGHT = sum(fv.GROUP_WEIGHTS.values())


def severity_weight(severity: Column) -> Column:
    return map_lookup(fv.SEVERITY_WEIGHTS, severity)


def group_scores(findings: Column, weights: dict[str, int] = fv.GROUP_WEIGHTS) -> Column:
    """array<struct<signal_group, weight, n, score>>, one entry per weighted group."""

    def entry(group: str, weight: int) -> Column:
        magnitudes = F.transform(
            F.filter(findings, lambda f: f["signal_group"] == group),
            lambda f: severity_weight(f["severity"]),
        )
        return F.struct(
            F.lit(group).alias("signal_group"),
            F.lit(weight).alias("weight"),
            F.size(magnitudes).alias("n"),
            saturating_fold(magnitudes).alias("score"),
        )

    return F.array(*[entry(g, w) for g, w in weights.items()])


def band_of(score: Column) -> Column:
    out = None
    for band, (low, high) in fv.BAND_RANGES.items():
        cond = score.between(low, high)
        out = F.when(cond, band) if out is None else out.when(cond, band)
    return out.otherwise("benign")


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + value(x))


def score_findings(messages: DataFrame, evaluated: Column | None = None) -> DataFrame:
    """Add score, band, classification and their derivation to rows with ``findings``.

    ``evaluated`` lists the groups that ran. The score is taken over their weight only, so a
    group that never ran is not mistaken for one that ran and found nothing.
    """
    evaluated = strings(fv.OFFLINE_GROUPS) if evaluated is None else evaluated
    base = (
        messages.withColumn("_evaluated", evaluated)
        .withColumn("group_scores", group_scores(F.col("findings")))
        .withColumn(
            "group_contributions",
            F.transform(
                F.filter(
                    "group_scores", lambda g: F.array_contains("_evaluated", g["signal_group"])
                ),
                lambda g: g.withField("contribution", F.bround(g["score"] * g["weight"], 2)),
            ),
        )
        .withColumn(
            "_available",
            F.coalesce(
                F.nullif(_sum(F.col("group_contributions"), lambda g: g["weight"]), F.lit(0.0)),
                F.lit(float(_TOTAL_WEIGHT)),
            ),
        )
        .withColumn("_raw", _sum(F.col("group_contributions"), lambda g: g["contribution"]))
    )
    content = F.filter("group_contributions", lambda g: g["signal_group"] == "content")
    content_weight = _sum(content, lambda g: g["weight"])
    content_part = _sum(content, lambda g: g["contribution"])
    strong = F.transform(
        F.filter("group_scores", lambda g: (g["n"] > 0) & (g["score"] >= fv.CORROBORATION_THRESHOLD)),
        lambda g: g["signal_group"],
    )
    rule_ids = F.transform("findings", lambda f: f["rule_id"])
    impersonation = F.arrays_overlap(rule_ids, strings(_IMPERSONATION))
    terms = base.select(
        "*",
        (
            (F.col("_raw") - content_part)
            / F.greatest(F.lit(1.0), F.col("_available") - content_weight)
            * 100.0
        ).alias("_non_content"),
        (F.col("_raw") / F.col("_available") * 100.0).alias("_base"),
        strong.alias("_strong"),
        F.size(F.array_intersect(strong, strings(fv.DETERMINISTIC_GROUPS))).alias("_strong_det"),
        F.coalesce(impersonation, F.lit(False)).alias("_impersonation"),
        F.array_contains(rule_ids, "AUTH_DMARC_ALIGNED_ESTABLISHED").alias("_established"),
        rule_ids.alias("_rules"),
    )
    ceiling = (F.col("_non_content") < fv.AI_CEILING) & (F.col("_base") > fv.AI_CEILING)
    limited = terms.withColumn("_ceiling", ceiling).withColumn(
        "_base", F.when(ceiling, F.lit(float(fv.AI_CEILING))).otherwise(F.col("_base"))
    )
    corroborated = (F.size("_strong") >= fv.CORROBORATION_GROUPS) & (
        F.col("_strong_det") >= fv.CORROBORATION_DETERMINISTIC
    )
    capped = ~corroborated & (F.col("_base") > fv.CAP_WITHOUT_CORROBORATION)
    gated = (
        limited.withColumn("_corroborated", corroborated)
        .withColumn("_capped", capped)
        .withColumn("_dampened", F.col("_established") & ~F.col("_impersonation"))
        .withColumn(
            "_base",
            F.when(F.col("_capped"), F.lit(float(fv.CAP_WITHOUT_CORROBORATION))).otherwise(
                F.col("_base")
            )
            + F.when(F.col("_dampened"), F.lit(float(fv.LEGITIMACY_DAMPENER))).otherwise(0.0),
        )
    )
    scored = gated.withColumn(
        "score", F.least(F.lit(100), F.greatest(F.lit(0), F.bround("_base", 0).cast("int")))
    ).withColumn("band", band_of(F.col("score")))
    return scored.select(
        *[c for c in messages.columns if c != "findings"],
        _with_contributions().alias("findings"),
        F.filter("group_scores", lambda g: g["n"] > 0).alias("group_scores"),
        "group_contributions",
        "score",
        "band",
        classify().alias("classification"),
        F.size("_evaluated").alias("data_completeness"),
        F.lit(fv.WEIGHTS_VERSION).alias("weights_version"),
        _controls_text().alias("controls_applied"),
    )


def _with_contributions() -> Column:
    """Each finding's share of its group's weight."""

    def share(f: Column) -> Column:
        group = F.get(
            F.filter("group_scores", lambda g: g["signal_group"] == f["signal_group"]), 0
        )
        value = (
            severity_weight(f["severity"])
            * F.coalesce(group["weight"], F.lit(0))
            / F.greatest(F.lit(1), F.coalesce(group["n"], F.lit(1)))
        )
        return f.withField("score_contribution", F.bround(value, 2))

    return F.transform("findings", share)


def classify() -> Column:
    """What kind of attack it is, from which rules and groups fired; order is precedence."""

    def group_score(name: str) -> Column:
        entry = F.get(F.filter("group_scores", lambda g: g["signal_group"] == name), 0)
        return F.coalesce(entry["score"], F.lit(0.0))

    def fired(rule: str) -> Column:
        return F.array_contains("_rules", rule)

    impersonation = F.col("_impersonation")
    return (
        F.when(F.col("band") == "benign", "benign")
        .when(
            impersonation & fired("CONTENT_FINANCIAL") & (group_score("authentication") >= 0.5),
            "bec",
        )
        .when(fired("URL_CREDENTIAL_LANDING"), "credential_phishing")
        .when(group_score("attachment") >= 0.7, "malware_delivery")
        .when(impersonation, "impersonation")
        .when(F.col("band").isin("high", "critical"), "phishing")
        .otherwise("unknown")
    )


def _controls_text() -> Column:
    available = F.format_string("%.0f", "_available")
    missing = F.array_sort(F.array_except(strings(fv.GROUP_WEIGHTS), F.col("_evaluated")))
    gate = (
        f" -- a Critical verdict needs {fv.CORROBORATION_GROUPS} independent groups >= "
        f"{fv.CORROBORATION_THRESHOLD}, at least {fv.CORROBORATION_DETERMINISTIC} deterministic "
    )
    return F.array_compact(
        F.array(
            F.when(
                F.col("_available") < _TOTAL_WEIGHT,
                F.concat(
                    F.lit("normalised over "), available,
                    F.lit(f"/{_TOTAL_WEIGHT} available weight; not evaluated: "),
                    F.array_join(missing, ", "),
                ),
            ),
            F.when(
                F.col("_ceiling"),
                F.concat(
                    F.lit("ai_ceiling: deterministic evidence alone scores "),
                    F.format_string("%.0f", F.bround("_non_content", 0)),
                    F.lit(
                        f", below {fv.AI_CEILING}; social-engineering signals cannot carry a "
                        "case past that on their own"
                    ),
                ),
            ),
            F.when(
                F.col("_capped"),
                F.concat(
                    F.lit(f"corroboration_gate: capped at {fv.CAP_WITHOUT_CORROBORATION}{gate}"),
                    F.format_string("(found %d / %d)", F.size("_strong"), F.col("_strong_det")),
                ),
            ).when(
                F.col("_corroborated"),
                F.concat(
                    F.format_string(
                        "corroboration_gate: satisfied by %d groups (", F.size("_strong")
                    ),
                    F.array_join(F.array_sort("_strong"), ", "),
                    F.lit(")"),
                ),
            ),
            F.when(
                F.col("_dampened"),
                f"legitimacy_dampener: {fv.LEGITIMACY_DAMPENER} "
                "(DMARC aligned to an established domain, no impersonation signal)",
            ),
        )
    )


def score_rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Per case and group: contribution, number of findings and techniques, from finding rows."""
    techniques = F.collect_set("mitre_technique")  # bounded by the rule catalogue
    return findings.groupBy(*keys, "signal_group").agg(
        F.bround(F.sum("score_contribution"), 2).alias("contribution"),
        F.count(F.lit(1)).alias("finding_count"),
        F.sort_array(techniques).alias("mitre_techniques"),
    ).withColumn("max_weight", map_lookup(fv.GROUP_WEIGHTS, F.col("signal_group")))


def score_derivation(rolled: DataFrame, weights: DataFrame, bands: DataFrame, *keys: str) -> DataFrame:
    """``score_rollup`` rows with ``score`` and ``band``: groups in order of contribution, their weight and the band's range.

    ``weights`` and ``bands`` are the published dimensions; a group or band they lack keeps its row.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("contribution"), "signal_group")
    return (
        rolled.withColumn("place", F.row_number().over(order))
        .join(weights.select("signal_group", "weight", "deterministic"), "signal_group", "left")
        .join(bands.select("band", "low", "high"), "band", "left")
    )
