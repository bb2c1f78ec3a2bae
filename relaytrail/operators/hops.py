"""Received headers to hops, and hops to an origin assessment.

A message's hops stay an array in its row, so reconstructing a trail never shuffles: every
check is linear in the number of hops of that message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.config import AnalysisConfig
from relaytrail.functions.core import any_suffix, blank_to_null, strings
from relaytrail.functions.dates import parse_mail_date
from relaytrail.functions.net import ip_canonical, ip_class
from relaytrail.functions.text import header_values

_PROVIDER_HOSTS = tuple(p for hosts in fv.TRUSTED_PROVIDERS.values() for p in hosts)
_VOUCHING_ROLES = ("org_internal", "trusted_provider", "known_forwarder")


def _find(c: Column, pattern: str) -> Column:
    return blank_to_null(F.regexp_extract(c, "(?U)" + pattern, 1))


def _host(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\.+$", ""))


def first_address(segment: Column) -> Column:
    """First valid address inside a bracketed or parenthesised clause, canonical."""
    clauses = F.regexp_extract_all(segment, F.lit(fv.CLAUSE_PATTERN), 1)
    tokens = F.flatten(
        F.transform(clauses, lambda c: F.regexp_extract_all(c, F.lit(fv.ADDRESS_TOKEN_PATTERN), 1))
    )
    trimmed = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.:]+|[.:]+$", ""))
    plausible = F.filter(trimmed, lambda t: (F.length(t) >= 3) & t.rlike("[.:]"))
    return F.get(F.filter(F.transform(plausible, ip_canonical), lambda a: a.isNotNull()), 0)


def _one_hop(raw: Column, seq: Column) -> Column:
    return F.struct(
        seq.alias("seq"),
        raw.alias("raw"),
        _host(_find(raw, fv.HELO_PATTERN)).alias("helo"),
        F.lower(_find(raw, fv.RDNS_PATTERN)).alias("rdns_claim"),
        first_address(F.split(raw, r"(?iU)\sby\s", 2)[0]).alias("observed_ip"),
        _host(_find(raw, fv.BY_PATTERN)).alias("by_host"),
        _find(raw, fv.WITH_PATTERN).alias("protocol"),
        _find(raw, fv.ID_PATTERN).alias("queue_id"),
        _find(raw, fv.TLS_PATTERN).alias("tls_info"),
        F.when(raw.contains(";"), parse_mail_date(F.substring_index(raw, ";", -1))).alias(
            "hop_ts_utc"
        ),
    )


def received_hops(headers: Column) -> Column:
    """Hops of a message, newest first; ``seq`` is the position of the header."""
    collapsed = F.transform(
        header_values(headers, "Received"),
        lambda v: F.trim(F.regexp_replace(v, r"(?U)[\s\x1c-\x1f]+", " ")),
    )
    return F.transform(
        F.transform(collapsed, _one_hop),
        lambda h: h.withField("ip_class", ip_class(h["observed_ip"])),
    )


def hop_role(h: Column, org_domains: Column, config: AnalysisConfig) -> Column:
    """How much the testimony of a hop is worth."""
    host, rdns = F.coalesce(h["by_host"], F.lit("")), F.coalesce(h["rdns_claim"], F.lit(""))
    dotted = config.label_boundary
    providers = strings(_PROVIDER_HOSTS)
    return (
        F.when(any_suffix(host, org_domains, dotted), "org_internal")
        .when(any_suffix(host, providers, dotted), "trusted_provider")
        .when(any_suffix(host, strings(config.forwarders), dotted), "known_forwarder")
        .when((rdns != "") & any_suffix(rdns, providers, dotted), "trusted_provider")
        .otherwise("external")
    )


def _boundary(hops: Column) -> Column:
    """Last hop of the leading run of vouching hops; NULL when the first is external."""
    first_external = F.array_position(F.transform(hops, lambda h: h["role"] == "external"), True)
    return (
        F.when(F.size(hops) == 0, F.lit(None))
        .when(first_external == 0, F.size(hops) - 1)
        .when(first_external > 1, (first_external - 2).cast("int"))
    )


def _neighbours(hops: Column) -> Column:
    """Each hop (``newer``) with the next one in the array (``older``)."""
    shifted = F.slice(hops, 2, F.greatest(F.size(hops), F.lit(1)))
    pairs = F.zip_with(
        hops, shifted, lambda a, b: F.struct(a.alias("newer"), b.alias("older"))
    )
    return F.filter(pairs, lambda p: p["older"].isNotNull())


def _backdated(hops: Column) -> Column:
    """Hops whose time lies before the next older timed hop by more than the clock skew."""
    timed = F.filter(hops, lambda h: h["hop_ts_utc"].isNotNull())
    late = F.filter(
        _neighbours(timed),
        lambda p: F.unix_micros(p["newer"]["hop_ts_utc"]) + fv.CLOCK_SKEW_SECONDS * 1_000_000
        < F.unix_micros(p["older"]["hop_ts_utc"]),
    )
    return F.transform(late, lambda p: p["newer"]["seq"])


def _broken_handoffs(hops: Column) -> Column:
    """Hops whose receiving host is not the host the hop above says it got the message from."""

    def broken(p: Column) -> Column:
        claimed, actual = p["newer"]["helo"], p["older"]["by_host"]
        return F.coalesce(
            (claimed != "") & (actual != "")
            & ~claimed.endswith(actual) & ~actual.endswith(claimed),
            F.lit(False),
        )

    return F.transform(F.filter(_neighbours(hops), broken), lambda p: p["older"]["seq"])


def _private_after_public(hops: Column, boundary: Column) -> Column:
    """Private peers below the boundary that come after (are newer than) a public one."""
    below = F.filter(hops, lambda h: h["seq"] > boundary)
    oldest_public = F.array_max(
        F.transform(F.filter(below, lambda h: h["ip_class"] == "public"), lambda h: h["seq"])
    )
    hit = F.filter(
        below,
        lambda h: h["ip_class"].isin("private", "loopback")
        & F.coalesce(h["seq"] < oldest_public, F.lit(False)),
    )
    return F.coalesce(F.transform(hit, lambda h: h["seq"]), F.array().cast("array<int>"))


def reconstruct_origin(
    messages: DataFrame, config: AnalysisConfig = AnalysisConfig(), forged_auth: Column | None = None
) -> DataFrame:
    """Add roles, trust, anomalies, boundary, first external sender, confidence and claim.

    Needs ``hops`` and ``protected_domains`` columns. ``forged_auth`` says whether untrusted
    authentication results claimed a pass.
    """
    forged_auth = F.lit(False) if forged_auth is None else forged_auth
    with_roles = messages.withColumn(
        "hops",
        F.transform(
            "hops", lambda h: h.withField("role", hop_role(h, F.col("protected_domains"), config))
        ),
    ).withColumn("boundary_seq", _boundary(F.col("hops")))
    with_marks = with_roles.select(
        "*",
        _backdated(F.col("hops")).alias("_backdated"),
        _broken_handoffs(F.col("hops")).alias("_broken"),
        _private_after_public(F.col("hops"), F.col("boundary_seq")).alias("_private"),
    )

    def mark(h: Column) -> Column:
        codes = F.array_compact(
            F.array(
                F.when(F.array_contains("_backdated", h["seq"]), "timestamp_not_monotonic"),
                F.when(F.array_contains("_broken", h["seq"]), "handoff_discontinuity"),
                F.when(F.array_contains("_private", h["seq"]), "private_ip_after_public"),
            )
        )
        boundary = F.col("boundary_seq")
        trust = (
            F.when(h["seq"] < boundary, "vouched")
            .when(h["seq"] == boundary, "boundary")
            .when(F.array_contains(codes, "timestamp_not_monotonic"), "forged")
            .otherwise("asserted")
        )
        return h.withField("trust_state", trust).withField("anomalies", codes)

    forwarded = F.exists(
        F.slice("hops", 1, F.coalesce(F.col("boundary_seq"), F.lit(-1)) + 1),
        lambda h: h["role"] == "known_forwarder",
    )
    public_peer = F.filter(
        "hops",
        lambda h: (h["seq"] >= F.col("boundary_seq"))
        & (h["ip_class"] == "public")
        & h["observed_ip"].isNotNull(),
    )
    marked = with_marks.select(
        *[c for c in messages.columns if c != "hops"],
        "boundary_seq",
        F.transform("hops", mark).alias("hops"),
        F.get(public_peer, 0)["observed_ip"].alias("feos_ip"),
        F.when(F.size("hops") == 0, strings(["no_received_headers"])).otherwise(
            F.array_compact(
                F.array(
                    F.when(forwarded, "forwarding_suspected"),
                    F.when(F.size("_backdated") > 0, "timestamp_not_monotonic"),
                    F.when(F.size("_broken") > 0, "handoff_discontinuity"),
                    F.when(F.size("_private") > 0, "private_ip_after_public"),
                    F.when(forged_auth, "forged_authentication_results"),
                )
            )
        ).alias("origin_flags"),
    )
    scored = marked.withColumn("confidence_breakdown", _confidence_terms()).withColumn(
        "origin_confidence",
        F.when(F.size("hops") == 0, 10).otherwise(
            F.greatest(
                F.lit(5),
                F.least(
                    F.lit(95),
                    F.aggregate(
                        "confidence_breakdown", F.lit(0), lambda s, t: s + t["value"]
                    ),
                ),
            )
        ),
    )
    return scored.withColumn("claim_text", _claim())


def _confidence_terms() -> Column:
    """Named terms in the order they are shown; their sum, clamped, is the confidence."""
    flags, boundary = F.col("origin_flags"), F.col("boundary_seq")

    def term(name: str, value: int) -> Column:
        return F.struct(F.lit(name).alias("term"), F.lit(value).alias("value"))

    def has(flag: str) -> Column:
        return F.array_contains(flags, flag)

    boundary_role = F.get("hops", boundary)["role"]
    shared_esp = F.exists(
        "hops",
        lambda h: F.exists(
            strings(fv.SHARED_ESP_MARKERS),
            lambda m: F.coalesce(h["rdns_claim"].contains(m), F.lit(False)),
        ),
    )
    terms = F.array_compact(
        F.array(
            term("base", 50),
            F.when(boundary.isNull(), term("no_trusted_receiving_infrastructure", -35)).when(
                boundary_role.isin("org_internal", "trusted_provider"),
                term("boundary_at_recognised_infrastructure", 20),
            ),
            F.when(has("handoff_discontinuity"), term("handoff_discontinuity", -10)).otherwise(
                term("handoff_continuity_intact", 10)
            ),
            F.when(
                has("timestamp_not_monotonic"), term("forged_header_below_boundary", -10)
            ).otherwise(term("timestamps_monotonic", 10)),
            F.when(F.col("feos_ip").isNull(), term("no_public_sender_observed", -20)),
            F.when(has("forwarding_suspected"), term("forwarding_suspected", -15)),
            F.when(
                has("forged_authentication_results"), term("injected_authentication_results", -5)
            ),
            F.when(F.size("hops") < 2, term("single_hop_nothing_to_corroborate", -8)),
            F.when(shared_esp, term("shared_esp_true_origin_unrecoverable", -12)),
        )
    )
    return F.when(F.size("hops") == 0, F.array(term("no_received_headers", -40))).otherwise(terms)


def _claim() -> Column:
    boundary_hop = F.get("hops", F.col("boundary_seq"))
    trusted = boundary_hop["role"].isin("org_internal", "trusted_provider")
    where = F.when(
        trusted,
        F.concat(
            F.lit("before the message entered "),
            F.coalesce(boundary_hop["by_host"], F.lit("the first trusted hop")),
        ),
    ).otherwise("in the observed chain")
    claim = F.format_string(fv.CLAIM_TEMPLATE, F.col("feos_ip"), F.col("origin_confidence"), where)
    suffix = F.when(
        F.array_contains("origin_flags", "forwarding_suspected"), fv.CLAIM_FORWARDED
    ).otherwise("")
    return (
        F.when(F.size("hops") == 0, fv.CLAIM_NO_HEADERS)
        .when(F.col("feos_ip").isNull() | F.col("boundary_seq").isNull(), fv.CLAIM_REFUSED)
        .otherwise(F.concat(claim, suffix))
    )


def hop_rows(analysed: DataFrame, *keys: str) -> DataFrame:
    """One row per hop."""
    return analysed.select(*keys, F.inline("hops"))
