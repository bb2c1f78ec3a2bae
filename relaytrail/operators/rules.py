"""Finding rules.

Every rule is one column expression over the message row that yields a finding or NULL. A
message's findings stay an array until a table of them is asked for, so rules and scoring run
in the same stage without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.config import AnalysisConfig
from relaytrail.functions.core import before_first, let, map_lookup, strings
from relaytrail.functions.net import registrable_domain, url_host
from relaytrail.functions.similarity import within_osa
from relaytrail.functions.text import confusable_skeleton, header_values, quote_around

FINDING_FIELDS = (
    "signal_group", "rule_id", "severity", "title", "detail", "evidence_ref", "evidence_quote",
    "mitre_technique",
)
LOOKALIKE_LIMIT = 3


def _text(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def finding(
    rule: str,
    detail,
    ref=None,
    *,
    quote=None,
    severity=None,
    fill: Column | None = None,
    rule_fill: Column | None = None,
) -> Column:
    """A finding of a catalogued rule; ``fill`` goes into its title, ``rule_fill`` into its id."""
    group, default_severity, title, technique = fv.RULES[rule]
    values = (
        group,
        F.format_string(rule, rule_fill) if rule_fill is not None else rule,
        default_severity if severity is None else severity,
        F.format_string(title, fill) if fill is not None else title,
        detail,
        None if ref is None else _text(ref),
        quote,
        technique,
    )
    return F.struct(*[_text(v).alias(n) for v, n in zip(values, FINDING_FIELDS)])


def _compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def authentication_rules() -> Column:
    results = F.col("auth_results")
    ref = F.concat(
        F.lit("Authentication-Results ("), F.col("trusted_authserv_id"), F.lit(")")
    )

    def per_result(r: Column) -> Column:
        mech, passed = F.upper(r["mechanism"]), r["result_reported"] == "pass"
        return (
            F.when(
                passed & (r["aligned"] == F.lit(False)) & ~F.col("dmarc_aligned"),
                finding(
                    "AUTH_%s_PASS_UNALIGNED",
                    F.concat(
                        mech,
                        F.lit(" vouches for a domain the sender owns; the From line shows "),
                        F.coalesce("from_domain", F.lit("no domain")),
                    ),
                    ref, fill=mech, rule_fill=mech,
                ),
            )
            .when(
                r["result_reported"].isin("fail", "softfail"),
                finding(
                    "AUTH_%s_FAIL",
                    F.concat(
                        r["mechanism"], F.lit("="), r["result_reported"], F.lit(" reported by "),
                        F.col("trusted_authserv_id"),
                    ),
                    ref, fill=mech, rule_fill=mech,
                ),
            )
            .when(
                passed & r["aligned"] & (r["mechanism"] == "dmarc"),
                finding(
                    "AUTH_DMARC_ALIGNED_ESTABLISHED",
                    "Lowers the score unless a protected identity is impersonated",
                    "Authentication-Results",
                ),
            )
        )

    injected = F.when(
        F.col("forged_pass_detected"),
        finding(
            "AUTH_INJECTED_RESULTS",
            "A header outside the topmost trusted one claims a pass; it was discarded",
            "Authentication-Results",
        ),
    )
    missing = F.when(
        F.size(results) == 0,
        finding(
            "AUTH_NO_TRUSTED_RESULTS",
            "No evidence either way; completeness is reduced, not trust",
            "Authentication-Results",
        ),
    )
    return F.array_compact(F.concat(F.array(injected, missing), F.transform(results, per_result)))


def identity_rules(config: AnalysisConfig) -> Column:
    display = F.trim(F.coalesce("from_display", F.lit("")))
    domain = F.lower(F.coalesce("from_domain", F.lit("")))
    protected_name = F.get(
        F.filter("protected_identities", lambda p: F.lower(display).contains(F.lower(p))), 0
    )
    skeleton = confusable_skeleton(F.coalesce("from_domain_nfkc", F.lit("")))
    lookalike = F.get(
        F.filter(
            "protected_domains",
            lambda p: (domain != p)
            & (
                domain.contains(before_first(p, "."))
                | within_osa(skeleton, confusable_skeleton(p), LOOKALIKE_LIMIT)
            ),
        ),
        0,
    )
    reply = F.col("reply_to_domain")
    bounce = F.substring_index("return_path", "@", -1)
    suffixes = strings(config.public_suffixes)
    return _compact(
        F.when(
            F.size(header_values(F.col("headers"), "From")) > 1,
            finding(
                "IDENT_DUPLICATE_FROM",
                "More than one From header: readers and filters can be shown different senders",
                "From",
            ),
        ),
        F.when(
            display.rlike(fv.INVISIBLE_PATTERN),
            finding(
                "IDENT_INVISIBLE_CHARS",
                "Zero-width or direction-control characters in the display name",
                display,
            ),
        ),
        let(
            protected_name,
            lambda name: F.when(
                (display != "") & name.isNotNull(),
                finding(
                    "IDENT_PROTECTED_DISPLAY_NAME",
                    "Most clients show only this name, not the address behind it",
                    display, fill=name,
                ),
            ),
        ),
        let(
            lookalike,
            lambda near: F.when(
                (domain != "") & near.isNotNull(),
                finding(
                    "IDENT_LOOKALIKE_DOMAIN",
                    F.concat(
                        domain, F.lit(" resembles "), near,
                        F.lit(" after mapping confusable characters"),
                    ),
                    F.concat(domain, F.lit(" ~ "), near), fill=near,
                ),
            ),
        ),
        F.when(
            (reply != "") & (domain != "") & (reply != domain),
            finding(
                "IDENT_REPLY_TO_DIVERGENT",
                "Replies leave the domain of the From line",
                F.concat(F.lit("From: "), domain, F.lit(" / Reply-To: "), reply),
            ),
        ),
        F.when(
            reply.isin(*fv.FREEMAIL_DOMAINS)
            & ~F.coalesce(F.col("from_domain").isin(*fv.FREEMAIL_DOMAINS), F.lit(False)),
            finding(
                "IDENT_REPLY_TO_FREEMAIL",
                "A corporate sender whose replies go to a consumer mailbox",
                F.concat(F.lit("Reply-To: "), reply),
            ),
        ),
        F.when(
            (F.col("return_path") != "")
            & (F.col("from_domain") != "")
            & ~F.col("dmarc_aligned")
            & (
                registrable_domain(bounce, suffixes)
                != registrable_domain(F.col("from_domain"), suffixes)
            ),
            finding(
                "IDENT_RETURN_PATH_DIVERGENT",
                F.concat(F.lit("Bounces go to "), bounce, F.lit(", From shows "), F.col("from_domain")),
                F.concat(F.lit("Return-Path: "), F.col("return_path")),
            ),
        ),
    )


def infrastructure_rules() -> Column:
    boundary = F.col("boundary_seq")
    asserted = F.size("hops") - 1 - boundary
    return _compact(
        F.when(
            F.array_contains("origin_flags", "timestamp_not_monotonic"),
            finding(
                "INFRA_FORGED_RECEIVED",
                "A hop claims a time before the hop it followed, beyond clock skew",
                "Received chain",
            ),
        ),
        F.when(
            F.array_contains("origin_flags", "handoff_discontinuity"),
            finding(
                "INFRA_HANDOFF_BREAK",
                "A hop took the message from a host the next hop does not claim to be",
                "Received chain",
            ),
        ),
        F.when(
            boundary.isNull() & (F.size("hops") > 0),
            finding(
                "INFRA_NO_TRUST_BOUNDARY", "The origin cannot be attributed", "Received chain"
            ),
        ),
        F.when(
            F.col("feos_ip").isNotNull() & (asserted > 0),
            finding(
                "INFRA_ASSERTED_HOPS",
                "Kept as the sender's own account of the path, never scored as evidence",
                F.format_string("hops %d..%d", boundary + 1, F.size("hops") - 1),
                fill=asserted.cast("string"),
            ),
        ),
    )


def url_rules(config: AnalysisConfig) -> Column:
    urls = F.col("urls")
    markers, suffixes = strings(fv.CREDENTIAL_URL_MARKERS), strings(config.public_suffixes)
    landing = F.get(
        F.filter(urls, lambda u: F.exists(markers, lambda m: F.lower(u).contains(m))), 0
    )

    def landing_finding(url: Column) -> Column:
        own_domain = F.coalesce(
            registrable_domain(url_host(url), suffixes)
            == registrable_domain(F.col("from_domain"), suffixes),
            F.lit(False),
        )

        def graded(own: Column) -> Column:
            established = own & F.col("dmarc_aligned")
            return finding(
                "URL_CREDENTIAL_LANDING",
                F.when(established, "Sign-in page on the sender's own, aligned domain")
                .when(own, "Sign-in page on the sender's own domain, nothing aligned")
                .otherwise("Sign-in page on a domain other than the sender's"),
                url,
                severity=F.when(established, "low").when(own, "medium").otherwise("high"),
            )

        return F.when(url.isNotNull(), let(own_domain, graded))

    def imitated(u: Column) -> Column:
        return let(
            url_host(u),
            lambda host: F.filter(
                "protected_domains", lambda p: (host != p) & host.contains(before_first(p, "."))
            ),
        )

    def imitation_finding(url: Column) -> Column:
        row = finding(
            "URL_LOOKALIKE_HOST",
            F.concat(url_host(url), F.lit(" embeds a protected name")),
            url, fill=F.get(imitated(url), 0),
        )
        return F.when(url.isNotNull(), row)

    imitation = F.get(F.filter(urls, lambda u: F.size(imitated(u)) > 0), 0)
    return _compact(let(landing, landing_finding), let(imitation, imitation_finding))


def attachment_rules() -> Column:
    def rule(a: Column) -> Column:
        name = F.coalesce(a["filename"], F.lit("None"))
        return (
            F.when(
                a["extension_mismatch"],
                finding(
                    "ATTACH_TYPE_MISMATCH",
                    F.concat(F.lit("Declared as "), a["content_type"]), a["sha256"], fill=name,
                ),
            )
            .when(
                a["is_archive"],
                finding("ATTACH_ARCHIVE", "Hashed, never expanded", a["sha256"], fill=name),
            )
            .otherwise(
                finding(
                    "ATTACH_PRESENT", "Hashed, never opened", a["sha256"],
                    fill=F.coalesce(a["filename"], a["content_type"]),
                )
            )
        )

    return F.transform("attachments", rule)


def content_rules(body: Column, lexicon=fv.CONTENT_LEXICON) -> Column:
    """Lexical markers: per rule the first listed term that occurs, with a quote around it.

    The body is lower-cased once per message, whatever the length of the lexicon.
    """

    def hit_row(rule_id: str, title: str, severity: str, lowered: Column, hit: Column) -> Column:
        values = (
            "content", rule_id, severity, title, F.concat(F.lit("Term: "), hit), None,
            quote_around(body, lowered, hit), None,
        )
        return F.struct(*[_text(v).alias(n) for v, n in zip(values, FINDING_FIELDS)])

    def rule(lowered: Column, entry) -> Column:
        rule_id, title, severity, terms = entry
        first = F.get(F.filter(strings(terms), lambda t: lowered.contains(t)), 0)
        return let(
            first,
            lambda hit: F.when(hit.isNotNull(), hit_row(rule_id, title, severity, lowered, hit)),
        )

    return let(F.lower(body), lambda lowered: _compact(*[rule(lowered, e) for e in lexicon]))


def with_plain_text(findings: Column) -> Column:
    """Add the plain sentence of each finding's rule."""
    return F.transform(
        findings,
        lambda f: f.withField("plain_summary", map_lookup(fv.RULE_PLAIN_TEXT, f["rule_id"])),
    )


def apply_rules(messages: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Add ``findings``: all rules, in the order groups are reported."""
    found = F.concat(
        authentication_rules(), identity_rules(config), infrastructure_rules(),
        url_rules(config), attachment_rules(), content_rules(F.col("text_body")),
    )
    return messages.withColumn("findings", with_plain_text(found))


def finding_rows(analysed: DataFrame, *keys: str) -> DataFrame:
    """One row per finding."""
    return analysed.select(*keys, F.posexplode("findings").alias("position", "f")).select(
        *keys, "position", "f.*"
    )
