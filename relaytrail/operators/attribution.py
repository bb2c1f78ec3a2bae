"""Network attribution by longest prefix, and registrable domains by suffix table.

Both are equi-joins on masked keys, one candidate key per prefix length that occurs (at most 33
for IPv4 and 129 for IPv6), never range joins. Distinct addresses are attributed once and
joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import constant, spread_nulls
from relaytrail.functions.net import (
    hex_prefix, ip_canonical, ip_class, ip_hex, ip_version, is_documentation_range, trim_dots,
)

_INFO = ("asn", "org", "country", "network_type", "note")


def _lengths(prefixes: DataFrame) -> list[dict]:
    """Prefix lengths in use: at most 162 pairs whatever the size of the table."""
    rows = prefixes.select("version", "prefix_len").distinct().collect()
    return [{"version": r.version, "prefix_len": r.prefix_len} for r in rows]


def attribute_addresses(addresses: DataFrame, prefixes: DataFrame, ip: str = "ip") -> DataFrame:
    """One row per distinct address with network, country, ``source`` and ``note``."""
    distinct = addresses.select(F.col(ip).alias("ip")).distinct()
    canonical = ip_canonical(F.col("ip"))
    keyed = distinct.select("ip", canonical.alias("_ip")).select(
        "ip",
        "_ip",
        ip_version(F.col("_ip")).alias("version"),
        ip_hex(F.col("_ip")).alias("_hex"),
        (
            ip_class(F.col("_ip")).isin("private", "loopback", "link_local")
            & ~is_documentation_range(F.col("_ip"))
        ).alias("_local"),
    )
    lengths = constant(_lengths(prefixes), "array<struct<version:int,prefix_len:int>>")
    candidates = (
        keyed.where(F.col("_ip").isNotNull() & ~F.col("_local"))
        .select("ip", "version", "_hex", F.explode(lengths).alias("l"))
        .where(F.col("l.version") == F.col("version"))
        .select(
            "ip",
            "version",
            F.col("l.prefix_len").alias("prefix_len"),
            hex_prefix(F.col("_hex"), F.col("l.prefix_len")).alias("network_key"),
        )
    )
    best = (
        candidates.join(prefixes, ["version", "prefix_len", "network_key"])
        .groupBy("ip")
        .agg(F.max_by(F.struct("prefix", *_INFO), "prefix_len").alias("n"))
    )
    found = F.col("n").isNotNull()

    def info(name: str) -> Column:
        return F.when(F.col(f"n.{name}") != "", F.col(f"n.{name}"))

    return keyed.join(best, "ip", "left").select(
        "ip",
        F.nullif(F.col("n.asn").try_cast("int"), F.lit(0)).alias("asn"),
        info("org").alias("asn_org"),
        info("country").alias("country"),
        info("network_type").alias("net_type"),
        F.when(F.col("_local"), "local").when(found, "bundled-table").otherwise("unavailable")
        .alias("geo_source"),
        F.when(F.col("ip").isNull() | (F.col("ip") == ""), fv.NOTE_NO_ADDRESS)
        .when(F.col("_ip").isNull(), fv.NOTE_INVALID)
        .when(F.col("_local"), fv.NOTE_LOCAL)
        .when(found, F.coalesce(info("note"), F.lit(fv.NOTE_TABLE)))
        .otherwise(fv.NOTE_UNCOVERED)
        .alias("geo_note"),
        F.col("n.prefix").alias("matched_prefix"),
    )


def enrich_hops(hops: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Hop rows with the network of every public peer; other hops are never located."""
    public = F.when(F.col("ip_class") == "public", F.col("observed_ip"))
    keyed = hops.withColumn("_peer", public)
    networks = attribute_addresses(
        keyed.where(F.col("_peer").isNotNull()), prefixes, "_peer"
    ).where(F.col("geo_source") != "unavailable")
    info = networks.select(F.col("ip").alias("_peer"), "asn", "asn_org", "country", "net_type")
    return keyed.withColumn("_peer", spread_nulls(hops, F.col("_peer"))).join(info, "_peer", "left").drop("_peer")


def enrich_origin(origins: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Origin rows with the network of the first external sender and the dataset used."""
    networks = attribute_addresses(
        origins.where(F.col("feos_ip").isNotNull()), prefixes, "feos_ip"
    ).where(F.col("geo_source") != "unavailable")
    info = networks.select(
        F.col("ip").alias("_sender"),
        F.col("asn").alias("feos_asn"),
        F.col("asn_org").alias("feos_org"),
        F.col("country").alias("feos_country"),
        "net_type",
        F.col("geo_source").alias("geo_dataset"),
    )
    keyed = origins.withColumn("_sender", spread_nulls(origins, F.col("feos_ip")))
    return keyed.join(info, "_sender", "left").drop("_sender").withColumn(
        "geo_available", F.col("geo_dataset").isNotNull()
    )


def with_registrable_domain(
    rows: DataFrame, domain: str, suffixes: DataFrame, out: str = "registrable"
) -> DataFrame:
    """Registrable domain by a suffix table of any size (``suffix`` column).

    Distinct domains are split into their label tails, joined to the table, and the longest
    listed tail plus one label wins; last two labels otherwise.
    """
    distinct = rows.select(F.col(domain).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    tails = distinct.select(
        "_d", F.split(F.lower(trim_dots(F.col("_d"))), r"\.").alias("labels")
    ).select(
        "_d", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("at")
    )
    listed = tails.select(
        "*",
        F.array_join(F.slice("labels", F.col("at"), F.size("labels")), ".").alias("suffix"),
        F.when(
            F.col("at") > 1,
            F.array_join(F.slice("labels", F.col("at") - 1, F.size("labels")), "."),
        ).alias("name"),
    ).join(suffixes.select("suffix").distinct(), "suffix")
    best = listed.groupBy("_d").agg(F.min_by("name", "at").alias("_listed"))
    keyed = rows.withColumn("_key", spread_nulls(rows, F.col(domain)))
    joined = keyed.join(best, keyed["_key"] == best["_d"], "left")
    clean = F.lower(trim_dots(F.col(domain)))
    fallback = F.when(clean.contains("."), F.substring_index(clean, ".", -2)).otherwise(
        F.lower(F.col(domain))
    )
    return joined.select(*rows.columns, F.coalesce("_listed", fallback).alias(out))


def with_dataset_flags(
    rows: DataFrame, asn: bool = False, country: bool = False, bundled: bool = True
) -> DataFrame:
    """Provenance columns: which network datasets were available to the run."""
    return rows.withColumns(
        {
            "has_asn_dataset": F.lit(asn),
            "has_country_dataset": F.lit(country),
            "has_bundled_table": F.lit(bundled),
        }
    )
