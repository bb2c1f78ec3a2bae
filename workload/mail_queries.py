"""Queries over the mail corpus: parsing, trails, authentication, findings, scores, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.config import AnalysisConfig
from relaytrail.functions import net, text
from relaytrail.functions.core import strings
from relaytrail.operators import (
    attribution, auth, hops, indicators, narrative, numbering, parse, quality, report,
    responses, rules, score, verify, views,
)
from relaytrail.plans import ingest
from relaytrail.sources import messages, tables
from relaytrail.streaming.pipeline import verdict_counts
from workload.context import Context
from workload.mail_view import mail_rows, spread
from workload.oracle_base import HEADER_LIST, lit, mail_with, registrable_sql
from workload.registry import query

CONFIG = AnalysisConfig()


# ------------------------------------------------------------------ acquisition ---
@query(
    "message_acquire",
    mail_with(
        "SELECT k, octet_length(encode(raw)) AS size_bytes, sha256(raw) AS sha256, "
        "CASE WHEN octet_length(encode(raw)) > 4000 THEN 'too_large' END AS reject_reason, "
        "sha256(org_id || chr(0) || sha256(raw)) AS case_id FROM mail", "mail"),
)
def _(c: Context) -> DataFrame:
    return messages.acquire(c.raw, max_bytes=4000).select(
        "k", "size_bytes", "sha256", "reject_reason", "case_id"
    )


@query("base64url_decode", mail_with(
    "SELECT k, sha256(raw) AS sha256, octet_length(encode(raw)) AS size_bytes FROM mail", "mail"))
def _(c: Context) -> DataFrame:
    sent = F.rtrim(F.replace(F.replace(F.base64("content"), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_")), F.lit("="))
    decoded = c.raw.select("k", messages.base64url_bytes(sent).alias("content"))
    return messages.acquire(decoded.withColumn("org_id", F.lit("o"))).select("k", "sha256", "size_bytes")


@query("page_unwrap", mail_with(
    "SELECT k, CASE WHEN k % 3 < 2 THEN sha256(raw) END AS sha256 FROM mail", "mail"))
def _(c: Context) -> DataFrame:
    raw = F.decode("content", "UTF-8")
    escaped = F.replace(F.replace(F.replace(raw, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<!DOCTYPE html><html><body><pre class=\"raw_message_text\">"), escaped, F.lit("</pre></body></html>"))
    other = F.concat(F.lit("<html><body><pre>nothing here</pre>"), F.md5("content"), F.lit("</body></html>"))
    body = F.when(F.col("k") % 3 == 0, raw).when(F.col("k") % 3 == 1, page).otherwise(other)
    return c.raw.select("k", F.sha2(messages.pasted_bytes(messages.unwrap_page(body)), 256).alias("sha256"))


# ------------------------------------------------------------------ parsing ---
@query("mail_headers", mail_with(
    f"""SELECT k, ordinal, h.name AS name, h.value AS value_raw, row_number() OVER (PARTITION BY k, lower(h.name) ORDER BY ordinal) > 1 AS is_duplicate
    FROM (SELECT k, unnest({HEADER_LIST}) AS h, unnest(range(0, len({HEADER_LIST}))) AS ordinal FROM t)""", "mail"))
def _(c: Context) -> DataFrame:
    return parse.header_rows(c.analysed, "k")


@query("header_first_last", mail_with(
    """SELECT k, CASE WHEN kind = 7 THEN from_addr ELSE display || ' <' || from_addr || '>' END AS first_from,
    coalesce(from2, CASE WHEN kind = 7 THEN from_addr ELSE display || ' <' || from_addr || '>' END) AS last_from,
    subject, CASE WHEN from2 IS NULL THEN 1 ELSE 2 END AS from_count,
    len(list_filter([r0, r1, r2, r3, r4], lambda x: x IS NOT NULL)) AS received_count FROM mail""", "mail"))
def _(c: Context) -> DataFrame:
    headers = F.col("headers")
    return c.analysed.select(
        "k", text.header_value(headers, "FROM").alias("first_from"),
        F.try_element_at(parse.header_map(headers), F.lit("from")).alias("last_from"), "subject",
        F.size(text.header_values(headers, "from")).alias("from_count"),
        F.size(text.header_values(headers, "received")).alias("received_count"),
    )


@query("mail_bodies", mail_with(
    """SELECT k, sha256(text_body) AS body_sha256, length(text_body) AS body_chars, kind = 3 AS html_present, 'parsed' AS parse_status,
    0 AS defects FROM content""", "content"))
def _(c: Context) -> DataFrame:
    return c.analysed.select(
        "k", F.sha2("text_body", 256).alias("body_sha256"), F.length("text_body").alias("body_chars"),
        "html_present", "parse_status", F.size("defects").alias("defects"),
    )


@query("mail_attachments", mail_with(
    """SELECT k, att_name AS filename, att_type AS content_type, octet_length(encode(att_payload)) AS size_bytes, sha256(att_payload) AS sha256,
    kind = 5 AS is_archive, kind = 6 AS extension_mismatch FROM mail WHERE att_type IS NOT NULL""", "mail"))
def _(c: Context) -> DataFrame:
    return c.analysed.select("k", F.inline("attachments"))


@query("mail_urls", mail_with("SELECT k, position, url FROM urlp", "content"))
def _(c: Context) -> DataFrame:
    return c.analysed.select("k", F.posexplode("urls").alias("position", "url"))


@query("mail_addresses", mail_with(
    """SELECT k, display AS from_display, from_addr AS from_address, dom AS from_domain, reply_to AS reply_to_address, split_part(reply_to, '@', 2) AS reply_to_domain,
    return_path, make_timestamp(2026, 9, CAST(dd AS INT), CAST(hh AS INT), 5, 44.0) - to_minutes(CASE WHEN kind = 3 THEN -420 ELSE 330 END) AS sent_at, msgid AS message_id FROM mail""", "mail"))
def _(c: Context) -> DataFrame:
    return c.analysed.select(
        "k", "from_display", "from_address", "from_domain", "reply_to_address", "reply_to_domain",
        "return_path", "sent_at", "message_id",
    )


# ------------------------------------------------------------------ trail ---
@query("received_hops", mail_with(
    "SELECT k, seq, helo, rdns_claim, observed_ip, by_host, protocol, queue_id, tls_info, hop_ts_utc, ip_class FROM hop2", "hops", zone_at_end=True))
def _(c: Context) -> DataFrame:
    return hops.hop_rows(c.analysed, "k").select(
        "k", "seq", "helo", "rdns_claim", "observed_ip", "by_host", "protocol", "queue_id",
        "tls_info", "hop_ts_utc", "ip_class",
    )


@query("hop_trust", mail_with(
    "SELECT k, seq, role, trust_state, array_to_string(anomalies, ',') AS anomalies FROM hop3", "hops"))
def _(c: Context) -> DataFrame:
    return hops.hop_rows(c.analysed, "k").select(
        "k", "seq", "role", "trust_state", F.array_join("anomalies", ",").alias("anomalies"))


_CLAIM = f"""CASE WHEN n_hops = 0 THEN {lit(fv.CLAIM_NO_HEADERS)} WHEN feos_ip IS NULL OR boundary_seq IS NULL THEN {lit(fv.CLAIM_REFUSED)}
  ELSE printf({lit(fv.CLAIM_TEMPLATE)}, feos_ip, confidence, 'before the message entered ' || boundary_host) END"""


@query("origin_assessment", mail_with(
    f"SELECT k, boundary_seq, feos_ip, confidence AS origin_confidence, array_to_string(flags, ',') AS flags, {_CLAIM} AS claim_text FROM orig", "hops"))
def _(c: Context) -> DataFrame:
    return c.analysed.select(
        "k", "boundary_seq", "feos_ip", "origin_confidence",
        F.array_join("origin_flags", ",").alias("flags"), "claim_text")


@query("confidence_terms", mail_with(
    "SELECT k, position, t.term AS term, t.value AS value FROM (SELECT k, unnest(terms) AS t, unnest(range(0, len(terms))) AS position FROM orig)", "hops"))
def _(c: Context) -> DataFrame:
    return c.analysed.select("k", F.posexplode("confidence_breakdown").alias("position", "t")).select(
        "k", "position", "t.term", "t.value")


def prefix_table(c: Context) -> DataFrame:
    """Announced prefixes of the corpus: a /16 per campaign and a more specific /24 for half."""
    camps = c.table("documents").select(F.floor(F.col("doc_id") / 64).alias("camp")).distinct()
    blocks = camps.select((F.col("camp") % 200).alias("b")).distinct()
    wide = blocks.select(
        F.concat(F.lit("45."), "b", F.lit(".0.0/16")).alias("prefix"), (F.col("b") + 64500).cast("string").alias("asn"),
        F.concat(F.lit("Carrier "), "b").alias("org"), F.lit("IN").alias("country"), F.lit("isp").alias("network_type"), F.lit("").alias("note"))
    narrow = blocks.where("b % 2 = 0").select(
        F.concat(F.lit("45."), "b", F.lit(".7.0/24")).alias("prefix"), (F.col("b") + 65000).cast("string").alias("asn"),
        F.concat(F.lit("Host "), "b").alias("org"), F.lit("NL").alias("country"), F.lit("datacenter").alias("network_type"), F.lit("").alias("note"))
    fixed = c.spark.createDataFrame(
        [("198.51.100.0/24", "0", "RFC 5737 documentation range", "", "documentation", "synthetic corpus only"),
         ("2001:db8::/32", "0", "RFC 3849 documentation range", "", "documentation", "synthetic corpus only"),
         ("209.85.128.0/17", "15169", "Google LLC", "US", "datacenter", ""),
         ("167.89.0.0/17", "11377", "SendGrid", "US", "esp", ""),
         ("10.1.2.3/8", "1", "bad", "", "", ""), ("nonsense", "1", "bad", "", "", "")],
        tables.PREFIX_SCHEMA)
    return tables.prepare_prefixes(wide.unionByName(narrow).unionByName(fixed))


def prefixes(c: Context) -> DataFrame:
    """The prepared table, written once."""
    return c.shared("prefixes", lambda: prefix_table(c))


_NETWORKS = """net AS (SELECT DISTINCT observed_ip AS ip, CASE
   WHEN starts_with(observed_ip, '198.51.100.') OR starts_with(observed_ip, '2001:db8:') THEN NULL WHEN starts_with(observed_ip, '209.85.') THEN 15169 WHEN starts_with(observed_ip, '167.89.') THEN 11377
   WHEN starts_with(observed_ip, '45.') AND CAST(string_split(observed_ip, '.')[2] AS INT) % 2 = 0 THEN 65000 + CAST(string_split(observed_ip, '.')[2] AS INT)
   WHEN starts_with(observed_ip, '45.') THEN 64500 + CAST(string_split(observed_ip, '.')[2] AS INT) END AS asn,
  CASE WHEN starts_with(observed_ip, '198.51.100.') OR starts_with(observed_ip, '2001:db8:') THEN NULL WHEN starts_with(observed_ip, '209.85.') OR starts_with(observed_ip, '167.89.') THEN 'US'
   WHEN starts_with(observed_ip, '45.') AND CAST(string_split(observed_ip, '.')[2] AS INT) % 2 = 0 THEN 'NL' WHEN starts_with(observed_ip, '45.') THEN 'IN' END AS country,
  CASE WHEN starts_with(observed_ip, '198.51.100.') OR starts_with(observed_ip, '2001:db8:') THEN 'documentation' WHEN starts_with(observed_ip, '209.85.') THEN 'datacenter' WHEN starts_with(observed_ip, '167.89.') THEN 'esp'
   WHEN starts_with(observed_ip, '45.') AND CAST(string_split(observed_ip, '.')[2] AS INT) % 2 = 0 THEN 'datacenter' WHEN starts_with(observed_ip, '45.') THEN 'isp' END AS net_type
  FROM hop2 WHERE ip_class = 'public')"""


@query("hop_attribution", mail_with(
    f", {_NETWORKS} SELECT h.k, h.seq, h.observed_ip, n.asn, n.country, n.net_type FROM hop2 h LEFT JOIN net n ON n.ip = h.observed_ip AND h.ip_class = 'public'", "hops"))
def _(c: Context) -> DataFrame:
    return attribution.enrich_hops(hops.hop_rows(c.analysed, "k"), prefixes(c)).select(
        "k", "seq", "observed_ip", "asn", "country", "net_type")


@query("origin_attribution", mail_with(
    f", {_NETWORKS} SELECT o.k, o.feos_ip, n.asn AS feos_asn, n.country AS feos_country, CASE WHEN n.net_type IS NOT NULL THEN 'bundled-table' END AS geo_dataset, n.net_type IS NOT NULL AS geo_available FROM orig o LEFT JOIN net n ON n.ip = o.feos_ip", "hops"))
def _(c: Context) -> DataFrame:
    return attribution.enrich_origin(c.analysed.select("k", "feos_ip"), prefixes(c)).select(
        "k", "feos_ip", "feos_asn", "feos_country", "geo_dataset", "geo_available")


@query("handling_countries", mail_with(
    f", {_NETWORKS} SELECT DISTINCT h.k, n.country FROM hop2 h JOIN net n ON n.ip = h.observed_ip AND h.ip_class = 'public' WHERE n.country IS NOT NULL", "hops"))
def _(c: Context) -> DataFrame:
    return views.handling_countries(
        attribution.enrich_hops(hops.hop_rows(c.analysed, "k"), prefixes(c)), "k")


# ------------------------------------------------------------------ authentication ---
@query("auth_results", mail_with(
    "SELECT k, position, mechanism, result_reported, authserv_id, selector, d_domain, aligned FROM auth WHERE trusted", "hops"))
def _(c: Context) -> DataFrame:
    return auth.auth_rows(c.analysed, "k").select(
        "k", "position", "mechanism", "result_reported", "authserv_id", "selector", "d_domain", "aligned")


@query("auth_summary", mail_with(
    """SELECT s.k, s.trusted_authserv_id, s.forged AS forged_pass_detected, s.dmarc_aligned,
    (CASE WHEN m.ar1 IS NULL THEN 0 ELSE 1 END + CASE WHEN m.ar2 IS NULL THEN 0 ELSE 1 END - CASE WHEN s.n_trusted > 0 THEN 1 ELSE 0 END) AS discarded_headers
    FROM authsum s JOIN mail m ON m.k = s.k""", "hops"))
def _(c: Context) -> DataFrame:
    return c.analysed.select(
        "k", "trusted_authserv_id", "forged_pass_detected", "dmarc_aligned", "discarded_headers")


def dns_snapshot(c: Context) -> DataFrame:
    """DNS answers for the senders of the corpus: keys, policies and SPF for some of them."""
    domains = c.analysed.select("from_domain").where("from_domain IS NOT NULL").distinct()
    n = F.conv(F.substring(F.md5("from_domain"), 1, 4), 16, 10).cast("long")
    own = net.registrable_domain(F.col("from_domain"), strings(CONFIG.public_suffixes))

    def answer(name, records, cond) -> DataFrame:
        return domains.where(cond).select(name.alias("name"), records.alias("records"), F.lit(True).alias("resolved"))

    empty = strings([])
    keys = answer(F.concat(F.lit("mk2._domainkey."), F.col("from_domain")),
                  F.when(n % 2 == 0, strings(["v=DKIM1; p=abc"])).otherwise(empty), n % 5 != 0)
    policies = answer(F.concat(F.lit("_dmarc."), own),
                      F.when(n % 3 == 0, strings(["other", "V=DMARC1; p=reject; sp=none; aspf=s"]))
                      .when(n % 3 == 1, strings(["v=DMARC1; p=none"])).otherwise(empty), n % 7 != 0)
    spf = answer(F.col("from_domain"),
                 F.when(n % 4 == 0, strings(["v=spf1 include:x.test -all"]))
                 .when(n % 4 == 1, strings(["x", "v=spf1 +all"])).when(n % 4 == 2, strings(["v=spf1 mx all"]))
                 .otherwise(empty), n % 11 != 0)
    protected = c.spark.createDataFrame([("_dmarc.northbank.test", ["v=DMARC1; p=reject"], True)], "name string, records array<string>, resolved boolean")
    return keys.unionByName(policies).unionByName(spf).unionByName(protected).distinct()


_DNS = f""", ds AS (SELECT DISTINCT dom, CAST('0x' || substr(md5(dom), 1, 4) AS BIGINT) AS n, {registrable_sql('dom')} AS own FROM mail),
  pol AS (SELECT own AS name, min(CASE n % 3 WHEN 0 THEN 'reject' WHEN 1 THEN 'none' END) AS p, bool_or(n % 3 = 0) AS strict FROM ds WHERE n % 7 <> 0 GROUP BY own
    UNION ALL SELECT 'northbank.test', 'reject', false)"""


_PUBLISHED = "coalesce(kind IN (0, 1) AND n % 5 <> 0 AND n % 2 = 0, false)"
_WEAK = """list_filter([CASE WHEN regexp_extract(dkim, ' h=([^;]+)', 1) <> '' AND NOT list_contains(list_transform(string_split(regexp_extract(dkim, ' h=([^;]+)', 1), ':'), lambda h: lower(trim(h))), 'from')
    THEN 'the From header is NOT covered by the signature' END, CASE WHEN contains(dkim, ' l=') THEN 'an l= body-length limit permits content to be appended' END], lambda x: x IS NOT NULL)"""


@query("dkim_recheck", mail_with(f"""{_DNS}, ck AS (SELECT *, {_PUBLISHED} AS pub, k % 3 AS verdict, regexp_extract(dkim, ' s=([^;]+)', 1) AS sel, {_WEAK} AS weak FROM mail JOIN ds USING (dom) WHERE dkim IS NOT NULL)
    SELECT k, 'dkim' AS mechanism, CASE WHEN pub AND verdict = 0 THEN 'pass' WHEN pub AND verdict = 1 THEN 'fail' ELSE 'indeterminate' END AS result_recomputed, sel AS selector, dom AS d_domain,
    regexp_extract(dkim, ' h=([^;]+)', 1) AS h_tags, pub AS key_published, true AS aligned, CASE WHEN NOT pub THEN 'No key published for selector ''' || sel || ''': an expired check, not a failed one.'
      ELSE nullif(concat_ws('; ', CASE verdict WHEN 1 THEN 'Signature did not verify against the currently published key.' WHEN 2 THEN 'Signature was not verified.' END,
        CASE WHEN len(weak) > 0 THEN 'Signature weakness: ' || array_to_string(weak, ', ') END), '') END AS caveat FROM ck""", "mail"))
def _(c: Context) -> DataFrame:
    """Re-checks with what a verifier said of two thirds of the messages."""
    said = c.analysed.withColumn("verified", F.when(F.col("k") % 3 < 2, F.col("k") % 3 == 0))
    return verify.recheck_dkim(said, c.shared("dns", lambda: dns_snapshot(c)), "k", config=CONFIG, verdict="verified")


@query("dmarc_policies", mail_with(f"""{_DNS}, r AS (SELECT k, 'sender' AS role, {registrable_sql('dom')} AS own FROM mail UNION ALL SELECT k, 'impersonated', 'northbank.test' FROM f0 WHERE rule_id = 'IDENT_LOOKALIKE_DOMAIN')
    SELECT k, role, 'dmarc' AS mechanism, CASE WHEN p IS NULL THEN 'none' ELSE 'pass' END AS result_recomputed, own AS d_domain, p AS policy, CASE WHEN strict THEN 'none' END AS subdomain_policy,
    CASE WHEN strict THEN 's' ELSE 'r' END AS alignment_spf, 'r' AS alignment_dkim, p IS NOT NULL AS found FROM r JOIN pol ON pol.name = r.own""", "rules"))
def _(c: Context) -> DataFrame:
    return verify.dmarc_policies(c.analysed, c.shared("dns", lambda: dns_snapshot(c)), "k", config=CONFIG)


@query("spf_records", mail_with(f"""{_DNS} SELECT dom AS domain, n % 11 <> 0 AND n % 4 < 3 AS found, CASE WHEN n % 11 <> 0 THEN CASE n % 4 WHEN 0 THEN 'v=spf1 include:x.test -all' WHEN 1 THEN 'v=spf1 +all' WHEN 2 THEN 'v=spf1 mx all' END END AS raw,
    CASE WHEN n % 11 <> 0 THEN CASE n % 4 WHEN 0 THEN '-' WHEN 1 THEN '+' END END AS all_qualifier, n % 11 <> 0 AND n % 4 IN (1, 2) AS permissive, n % 11 <> 0 AS resolved FROM ds""", "mail"))
def _(c: Context) -> DataFrame:
    senders = c.analysed.select(F.col("from_domain").alias("domain"))
    return verify.spf_records(senders, c.shared("dns", lambda: dns_snapshot(c)))


@query("dkim_signatures", mail_with(
    """SELECT k, true AS signed, regexp_extract(dkim, ' s=([^;]+)', 1) AS selector, regexp_extract(dkim, ' d=([^;]+)', 1) AS d_domain,
    regexp_extract(dkim, ' h=([^;]+)', 1) AS signed_headers, contains(dkim, ' l=') AS length_limited FROM mail WHERE dkim IS NOT NULL""", "mail"))
def _(c: Context) -> DataFrame:
    return verify.dkim_signatures(c.analysed, "k").where("signed").select(
        "k", "signed", "selector", "d_domain", F.array_join("signed_headers", ":").alias("signed_headers"), "length_limited")


@query("identifier_alignment", mail_with(
    f"""SELECT k, bounce = dom AS strict, CASE WHEN bounce IS NOT NULL THEN ({registrable_sql('bounce')}) = ({registrable_sql('dom')}) END AS relaxed
    FROM (SELECT k, dom, split_part(return_path, '@', 2) AS bounce FROM mail)""", "mail"))
def _(c: Context) -> DataFrame:
    bounce, suffixes = net.address_domain(F.col("return_path")), strings(CONFIG.public_suffixes)
    return c.analysed.select(
        "k", verify.aligned(bounce, F.col("from_domain"), F.lit("s"), suffixes).alias("strict"),
        verify.aligned(bounce, F.col("from_domain"), F.lit("r"), suffixes).alias("relaxed"))


# ------------------------------------------------------------------ findings and scores ---
@query("findings", mail_with(
    f"""SELECT k, signal_group, rule_id, severity, title, evidence_ref, evidence_quote, mitre_technique, score_contribution,
    CASE rule_id {' '.join(f'WHEN {lit(r)} THEN {lit(t)}' for r, t in fv.RULE_PLAIN_TEXT.items())} END AS plain_summary FROM fnd"""))
def _(c: Context) -> DataFrame:
    return rules.finding_rows(c.analysed, "k").select(
        "k", "signal_group", "rule_id", "severity", "title", "evidence_ref", "evidence_quote",
        "mitre_technique", "score_contribution", "plain_summary")


@query("case_scores", mail_with(
    "SELECT k, score, band, classification, 6 AS data_completeness, 'v1' AS weights_version, controls AS controls_applied FROM sc"))
def _(c: Context) -> DataFrame:
    return c.analysed.select(
        "k", "score", "band", "classification", "data_completeness", "weights_version",
        F.array_join("controls_applied", " | ").alias("controls_applied"))


@query("group_scores", mail_with("SELECT k, signal_group, weight, n, score FROM gs"))
def _(c: Context) -> DataFrame:
    return c.analysed.select("k", F.inline("group_scores"))


@query("score_rollup", mail_with(
    """SELECT k, signal_group, CAST(round(sum(score_contribution), 2) AS DOUBLE) AS contribution, count(*) AS finding_count, any_value(weight) AS max_weight,
    coalesce(array_to_string(list_sort(list(DISTINCT mitre_technique) FILTER (mitre_technique IS NOT NULL)), ','), '') AS mitre_techniques FROM fnd GROUP BY k, signal_group"""))
def _(c: Context) -> DataFrame:
    return score.score_rollup(rules.finding_rows(c.analysed, "k"), "k").withColumn(
        "mitre_techniques", F.array_join("mitre_techniques", ","))


@query("severity_ranks", mail_with(
    "SELECT k, rule_id, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END AS severity_rank FROM fnd"))
def _(c: Context) -> DataFrame:
    return views.severity_rank(rules.finding_rows(c.analysed, "k")).select("k", "rule_id", "severity_rank")


@query("case_techniques", mail_with(
    "SELECT m.k, coalesce(string_agg(DISTINCT mitre_technique, ',' ORDER BY mitre_technique), '') AS techniques FROM mail m LEFT JOIN fnd f ON f.k = m.k GROUP BY m.k"))
def _(c: Context) -> DataFrame:
    found = F.array_compact(F.transform("findings", lambda f: f["mitre_technique"]))
    return c.analysed.select("k", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("techniques"))


@query("verdicts", mail_with(
    f"""SELECT k, score, band, classification, CASE WHEN band = 'benign' THEN {lit(fv.HEADLINE_BENIGN)} WHEN band IN ('high', 'critical') THEN 'This looks like ' || label || '. Do not act on it.'
    ELSE 'This may be ' || label || '. Treat it with caution.' END AS headline, CASE WHEN band = 'benign' THEN {lit(fv.ADVICE_BENIGN)} WHEN band IN ('high', 'critical') THEN {lit(fv.ADVICE_STRONG)} ELSE {lit(fv.ADVICE_WEAK)} END AS advice,
    CASE band {' '.join(f'WHEN {lit(b)} THEN {lit(t)}' for b, t in fv.PLAIN_BANDS.items())} END AS band_label
    FROM (SELECT *, CASE classification {' '.join(f'WHEN {lit(b)} THEN {lit(t)}' for b, t in fv.PLAIN_LABELS.items())} ELSE 'something suspicious' END AS label FROM sc)"""))
def _(c: Context) -> DataFrame:
    return narrative.verdicts(c.analysed, "k").select(
        "k", "score", "band", "classification", "headline", "advice", "band_label")


@query("narratives", mail_with(
    f""", tops AS (SELECT k, string_agg(title, '; ' ORDER BY score_contribution DESC, ord) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score_contribution DESC, ord) AS rn FROM fnd) WHERE rn <= 3 GROUP BY k)
    SELECT s.k, CASE WHEN band = 'benign' THEN printf({lit(fv.NARRATIVE_BENIGN)}, CAST(score AS VARCHAR)) ELSE printf({lit(fv.NARRATIVE_THREAT)}, replace(classification, '_', ' '), CAST(score AS VARCHAR), band,
    coalesce(t.reasons, 'no significant findings'), CAST(o.confidence AS VARCHAR)) END AS explanation, CASE WHEN band = 'benign' THEN 1 ELSE 3 END AS actions,
    CASE WHEN score < 40 THEN 'score ' || score || ' is below the generation threshold 40' END AS unavailable_reason FROM sc s JOIN orig o ON o.k = s.k LEFT JOIN tops t ON t.k = s.k"""))
def _(c: Context) -> DataFrame:
    return narrative.templated_narrative(c.analysed, "k").withColumn(
        "actions", F.size("recommended_actions")).drop("recommended_actions")


@query("passed_yet_impersonated", mail_with(
    """SELECT s.k, coalesce(a.ok, false) AS auth_passed, CASE WHEN list_contains(ids, 'IDENT_LOOKALIKE_DOMAIN') THEN 'IDENT_LOOKALIKE_DOMAIN' WHEN list_contains(ids, 'IDENT_PROTECTED_DISPLAY_NAME') THEN 'IDENT_PROTECTED_DISPLAY_NAME' END AS imitation_rule,
    coalesce(a.ok, false) AND imp AS callout FROM sc s LEFT JOIN (SELECT k, bool_and(result_reported = 'pass') AS ok FROM auth WHERE trusted GROUP BY k) a ON a.k = s.k"""))
def _(c: Context) -> DataFrame:
    return views.passed_yet_impersonated(c.analysed, "k")


@query("case_list", mail_with(
    """SELECT m.k, s.score, s.band, s.classification, m.acquired_at, m.subject, CASE WHEN kind = 7 THEN from_addr ELSE display || ' <' || from_addr || '>' END AS from_header
    FROM mail m JOIN sc s ON s.k = m.k ORDER BY m.acquired_at DESC LIMIT 500"""))
def _(c: Context) -> DataFrame:
    listed = views.case_list(c.analysed, limit=500)
    return listed.select(
        (F.unix_timestamp("acquired_at") - 1_788_220_800).cast("long").alias("s"), "*",
    ).select((F.col("s") / 60).cast("long").alias("k"), "score", "band", "classification", "acquired_at", "subject", "from_header")


@query("case_details", mail_with(
    """, g AS (SELECT k, string_agg(signal_group || '=' || printf('%.2f', c), ',' ORDER BY signal_group) AS group_contributions FROM (SELECT k, signal_group, round(sum(score_contribution), 2) AS c FROM fnd GROUP BY k, signal_group) GROUP BY k),
    u AS (SELECT k, string_agg(url, ' ' ORDER BY url) AS urls FROM urlp GROUP BY k)
    SELECT m.k, s.score, s.band, coalesce(from2, CASE WHEN kind = 7 THEN from_addr ELSE display || ' <' || from_addr || '>' END) AS from_last, reply_to, '<' || return_path || '>' AS return_path, msgid AS message_id,
    coalesce(g.group_contributions, '') AS group_contributions, coalesce(u.urls, '') AS urls FROM mail m JOIN sc s ON s.k = m.k LEFT JOIN g ON g.k = m.k LEFT JOIN u ON u.k = m.k"""))
def _(c: Context) -> DataFrame:
    groups = F.transform(
        F.array_sort(F.map_entries("group_contributions")),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))
    return views.case_details(c.analysed, "k").select(
        "k", "score", "band", F.col("from").alias("from_last"), "reply_to", "return_path", "message_id",
        F.array_join(groups, ",").alias("group_contributions"), F.array_join("urls", " ").alias("urls"))


@query("verdict_windows", mail_with(
    "SELECT date_trunc('hour', m.acquired_at) AS window_start, m.org_id, s.band, count(*) AS messages, max(s.score) AS max_score FROM mail m JOIN sc s ON s.k = m.k GROUP BY ALL"))
def _(c: Context) -> DataFrame:
    return verdict_counts(c.analysed)


# ------------------------------------------------------------------ indicators ---
_IND = """, ind0 AS (SELECT k, 'email' AS type, from_addr AS value FROM mail UNION ALL SELECT k, 'email', reply_to FROM mail UNION ALL SELECT k, 'domain', dom FROM mail UNION ALL SELECT k, 'message_id', msgid FROM mail
  UNION ALL SELECT k, 'ip', observed_ip FROM hop2 UNION ALL SELECT k, 'url', url FROM urlp WHERE position < 100 UNION ALL SELECT k, 'file_hash', sha256(att_payload) FROM mail),
  ind AS (SELECT i.k, m.org_id, i.type, lower(trim(i.value)) AS normalised, any_value(i.value) AS value FROM ind0 i JOIN mail m ON m.k = i.k WHERE i.value IS NOT NULL AND i.value <> '' GROUP BY i.k, m.org_id, i.type, lower(trim(i.value))),
  idf AS (SELECT c.org_id, c.normalised, c.df, t.n_cases, ln(t.n_cases / (1.0 + c.df)) AS idf FROM (SELECT org_id, normalised, count(DISTINCT k) AS df FROM ind GROUP BY ALL) c JOIN (SELECT org_id, count(DISTINCT k) AS n_cases FROM ind GROUP BY ALL) t ON t.org_id = c.org_id)"""
IND = _IND


@query("message_indicators", mail_with(f"{_IND} SELECT k, org_id, type, value, normalised FROM ind", "content"))
def _(c: Context) -> DataFrame:
    return c.indicators.select("k", "org_id", "type", "value", "normalised")


@query("indicator_idf", mail_with(
    f"{_IND} SELECT org_id, normalised, df, n_cases, round(idf, 6) AS idf, idf < 1.0 AS is_hub FROM idf", "content"))
def _(c: Context) -> DataFrame:
    return indicators.indicator_idf(c.indicators).select(
        "org_id", "normalised", "df", "n_cases", F.round("idf", 6).alias("idf"), "is_hub")


@query("indicator_pivot", mail_with(
    f"{_IND} SELECT i.org_id, i.type, i.normalised, i.k, p.n AS n_cases FROM ind i JOIN (SELECT org_id, type, normalised, count(DISTINCT k) AS n FROM ind GROUP BY ALL) p ON p.org_id = i.org_id AND p.type = i.type AND p.normalised = i.normalised", "content"))
def _(c: Context) -> DataFrame:
    pivot = indicators.indicator_pivot(c.indicators)
    return pivot.join(c.analysed.select("case_id", "k"), "case_id").select("org_id", "type", "normalised", "k", "n_cases")


# ------------------------------------------------------------------ ingest ---
@query("ingest_dedupe", mail_with("SELECT k, org_id, sha256(raw) AS sha256, acquired_at FROM mail WHERE k % 5 <> 0", "mail"))
def _(c: Context) -> DataFrame:
    """Every third message arrives twice; every fifth is a case already."""
    again = c.raw.where("k % 3 = 0").withColumn("acquired_at", F.col("acquired_at") + F.expr("INTERVAL 1 DAY"))
    acquired = messages.accepted(messages.acquire(c.raw.unionByName(again)))
    known = messages.acquire(c.raw.where("k % 5 = 0")).select("case_id")
    return ingest.new_messages(acquired, known).select("k", "org_id", "sha256", "acquired_at")


@query("case_refs", mail_with(
    """SELECT k, org_id, 'CASE-' || y || '-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS case_ref
    FROM (SELECT k, org_id, y, CASE WHEN y = 2026 THEN 7 ELSE 0 END + row_number() OVER (PARTITION BY org_id, y ORDER BY acquired_at, sha256(org_id || chr(0) || sha256(raw))) AS n FROM (SELECT *, year(acquired_at) AS y FROM mail))""", "mail"))
def _(c: Context) -> DataFrame:
    existing = c.raw.select("org_id").distinct().select(
        "org_id", F.explode(strings(["CASE-2026-0003", "CASE-2026-0007", "CASE-2025-0090", "CASE-2026-x"])).alias("case_ref"))
    numbered = numbering.next_case_refs(
        messages.acquire(c.raw).select("k", "org_id", "acquired_at", "case_id"), existing)
    return numbered.select("k", "org_id", "case_ref")


# ------------------------------------------------------------------ model inputs, reports ---
@query("model_payloads", mail_with("""SELECT k, sha256('{"email_body":' || to_json(text_body) || ',"established_facts":{"dmarc_aligned_to_claimed_identity":' || coalesce(d.ok, false) || ',"from_display":' || to_json(display)
    || ',"impersonation_rules_fired":[' || coalesce(i.r, '') || '],"reply_to_divergent":' || coalesce(reply_to <> from_addr, false) || '},"subject":' || to_json(subject) || '}') AS input_sha256
    FROM content c LEFT JOIN (SELECT k AS dk, bool_or(aligned) AS ok FROM auth WHERE trusted AND mechanism = 'dmarc' GROUP BY k) d ON d.dk = c.k
    LEFT JOIN (SELECT k AS ik, string_agg('"' || rule_id || '"', ',' ORDER BY rule_id) AS r FROM f0 WHERE starts_with(rule_id, 'IDENT_') GROUP BY k) i ON i.ik = c.k""", "rules"))
def _(c: Context) -> DataFrame:
    return responses.model_payloads(c.analysed, "k").select("k", "input_sha256")


@query("response_cache", mail_with(
    """, p AS (SELECT body, count(*) AS asked, min(k) AS k FROM mail GROUP BY body), c0 AS (SELECT *, k % 2 = 0 AS cached FROM p)
    SELECT sha256('m1' || chr(0) || 'v1' || chr(0) || sha256(body)) AS cache_key, CASE WHEN cached THEN asked ELSE 0 END AS hits, 'answer' AS response FROM c0""", "mail"))
def _(c: Context) -> DataFrame:
    """A cache that knows half of the bodies, after one round of requests."""
    view = spread(mail_rows(c.spark, c.sf_dir).select("k", "body"))
    requests = responses.with_cache_key(view.select("k", F.sha2("body", 256).alias("payload")), "m1", "v1")
    first = requests.groupBy("cache_key").agg(F.min("k").alias("k"))
    cache = first.where("k % 2 = 0").select("cache_key", F.lit("answer").alias("response"), F.lit(0).cast("long").alias("hits"))
    _, misses = responses.split_by_cache(requests, cache)
    answers = misses.select("cache_key", F.lit("answer").alias("response"))
    return responses.cache_after(cache, requests, answers)


@query("report_registry", mail_with(
    "SELECT k, CASE WHEN k % 3 = 0 THEN 3 ELSE 1 END AS version, 'ready' AS state, k % 4 = 0 AS drifted, sha256(sha256(org_id || chr(0) || sha256(raw))) AS merkle_root FROM mail", "mail"))
def _(c: Context) -> DataFrame:
    documents = report.case_documents(c.analysed, members=c.members)
    existing = c.analysed.where("k % 3 = 0").select("case_id", F.lit(2).alias("version"))
    roots = c.analysed.select("case_id", F.sha2("case_id", 256).alias("merkle_root"))
    registered = report.register_reports(documents, existing, roots)
    later = c.analysed.withColumn("score", F.when(F.col("k") % 4 == 0, F.col("score") + 1).otherwise(F.col("score")))
    now = report.case_documents(later, members=c.members)
    checked = report.report_drift(registered, now).join(c.analysed.select("case_id", "k"), "case_id")
    return checked.select("k", "version", "state", "drifted", "merkle_root")
