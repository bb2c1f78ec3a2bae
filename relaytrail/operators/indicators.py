"""Indicators: extraction, rarity, hubs and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import let, strip


def distinct_by_key(entries: Column) -> Column:
    """First entry of every ``key`` of an array of structs with ``key`` and ``at`` fields.

    Sorting puts equal keys side by side, so this is n log n in one row and needs no shuffle.
    """

    def first_of_keys(ordered: Column) -> Column:
        shifted = F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0)))
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(shifted, lambda e: e["key"]))
        paired = F.zip_with(ordered, before, lambda e, b: F.struct(e.alias("e"), b.alias("b")))
        first = F.filter(paired, lambda p: p["b"].isNull() | (p["b"] != p["e"]["key"]))
        return F.transform(first, lambda p: p["e"])

    return let(F.array_sort(entries), first_of_keys)


def message_indicators(analysed: DataFrame, *keys: str) -> DataFrame:
    """Indicator rows of each message: senders, Message-ID, peers, links and attachments.

    Distinct per (type, normalised) with the first source kept.
    """

    def typed(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    def one(kind: str, name: str) -> Column:
        return typed(kind, F.array(F.col(name)))

    listed = F.filter(
        F.concat(
            one("email", "from_address"),
            one("email", "reply_to_address"),
            one("domain", "from_domain"),
            one("message_id", "message_id"),
            typed("ip", F.transform("hops", lambda h: h["observed_ip"])),
            typed("url", F.col("urls")),
            typed("file_hash", F.transform("attachments", lambda a: a["sha256"])),
        ),
        lambda x: x["value"] != "",
    )
    named = F.transform(listed, lambda x: x.withField("normalised", F.lower(strip(x["value"]))))
    entries = F.transform(
        named,
        lambda x, i: F.struct(
            F.concat(x["type"], F.lit("\u0000"), x["normalised"]).alias("key"),
            i.alias("at"),
            x["type"].alias("type"),
            x["value"].alias("value"),
            x["normalised"].alias("normalised"),
        ),
    )
    return analysed.select(*keys, F.inline(distinct_by_key(entries))).drop("key", "at")


def indicator_idf(indicators: DataFrame) -> DataFrame:
    """ln(N / (1 + df)) per organisation and value, with the cases counted distinct.

    Both counts aggregate (organisation, value, case) first, so a value that a third of all
    cases share is combined before it is shuffled.
    """
    totals = indicators.groupBy("org_id").agg(F.count_distinct("case_id").alias("n_cases"))
    counts = indicators.groupBy("org_id", "normalised").agg(
        F.count_distinct("case_id").alias("df")
    )
    scored = counts.join(totals, "org_id").withColumn(
        "idf", F.ln(F.col("n_cases") / (F.lit(1.0) + F.col("df")))
    )
    return scored.withColumn("is_hub", F.col("idf") < fv.HUB_IDF_THRESHOLD)


def without_hubs(indicators: DataFrame, hub_values=fv.HUB_VALUES) -> DataFrame:
    """Drop values that connect everything to everything, before any join on them."""
    return indicators.where(~F.col("normalised").isin(*hub_values))


def indicator_pivot(indicators: DataFrame) -> DataFrame:
    """Where else a value was seen: one row per value and case with the value's case count.

    Kept in rows rather than collected per value, because a popular value has no bound.
    """
    seen = indicators.select("org_id", "type", "normalised", "case_id").distinct()
    counts = seen.groupBy("org_id", "type", "normalised").agg(F.count("*").alias("n_cases"))
    return seen.join(counts, ["org_id", "type", "normalised"])


