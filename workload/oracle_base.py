"""DuckDB common table expressions that recompute the analysis of the mail view.

Written against the view's columns, independently of the Spark operators.
"""

from __future__ import annotations

from relaytrail import fixed_values as fv
from relaytrail.config import AnalysisConfig
from workload.mail_view import HEADERS, mail_ctes

CONFIG = AnalysisConfig()
PROVIDERS = [p for hosts in fv.TRUSTED_PROVIDERS.values() for p in hosts]


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def strs(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def suffix_of(host: str, suffixes) -> str:
    return (
        f"len(list_filter({strs(suffixes)}, lambda s: {host} = s OR ends_with({host}, '.' || s))) > 0"
    )


HEADER_LIST = (
    "list_filter(["
    + ", ".join(f"{{'name': {lit(n)}, 'value': {v}}}" for n, v in HEADERS)
    + "], lambda x: x.value IS NOT NULL)"
)
_V4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def ip_class_sql(ip: str) -> str:
    def octet(i: int) -> str:
        return f"CAST(string_split({ip}, '.')[{i}] AS INT)"

    a, b, c = octet(1), octet(2), octet(3)
    return f"""CASE WHEN {ip} IS NULL THEN 'unknown'
      WHEN contains({ip}, ':') THEN CASE WHEN {ip} = '::1' THEN 'loopback' WHEN regexp_matches({ip}, '^fe[89ab]') THEN 'link_local'
        WHEN starts_with({ip}, '2001:db8:') THEN 'public' WHEN regexp_matches({ip}, '^f[cd]') THEN 'private'
        WHEN starts_with({ip}, 'ff') THEN 'reserved' ELSE 'public' END
      WHEN NOT regexp_matches({ip}, '{_V4}') THEN 'unknown'
      WHEN {a} = 127 THEN 'loopback' WHEN {a} = 169 AND {b} = 254 THEN 'link_local'
      WHEN ({a} = 192 AND {b} = 0 AND {c} = 2) OR ({a} = 198 AND {b} = 51 AND {c} = 100) OR ({a} = 203 AND {b} = 0 AND {c} = 113) THEN 'public'
      WHEN {a} = 100 AND {b} BETWEEN 64 AND 127 THEN 'cgnat'
      WHEN {ip} IN ('192.0.0.9', '192.0.0.10') THEN 'public'
      WHEN {a} IN (0, 10) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 0 AND {c} = 0)
        OR ({a} = 192 AND {b} = 168) OR ({a} = 198 AND {b} IN (18, 19)) OR {a} >= 240 THEN 'private'
      WHEN {a} BETWEEN 224 AND 239 THEN 'reserved' ELSE 'public' END"""


def last_two(x: str) -> str:
    return f"array_to_string(string_split(lower({x}), '.')[-2:], '.')"


def registrable_sql(x: str, suffixes=CONFIG.public_suffixes) -> str:
    n = f"len(string_split(lower({x}), '.'))"
    tail = f"array_to_string(string_split(lower({x}), '.')"
    best = f"list_filter(range(1, {n} + 1), lambda i: list_contains({strs(suffixes)}, {tail}[i:], '.')))[1]"
    return f"CASE WHEN {best} >= 2 THEN {tail}[{best} - 1:], '.') ELSE {last_two(x)} END"


def nn(x: str) -> str:
    return f"nullif({x}, '')"


def host_sql(u: str) -> str:
    return f"split_part(split_part(regexp_replace(lower({u}), '^.*?//', ''), '/', 1), ':', 1)"


_ZONE = "CASE WHEN contains(raw, '+0530') THEN 330 WHEN contains(raw, '-0700') THEN -420 WHEN contains(raw, '+0200') THEN 120 ELSE 0 END"
#: The zone where a date has it, at the end: a host such as desk-0700b6 is none.
_ZONE_AT_END = "CASE regexp_extract(raw, ' ([+-]\\d{4})$', 1) WHEN '+0530' THEN 330 WHEN '-0700' THEN -420 WHEN '+0200' THEN 120 ELSE 0 END"
_HOP = r"""
hop0 AS (SELECT * FROM (SELECT k, org_id, unnest([0, 1, 2, 3, 4]) AS seq, unnest([r0, r1, r2, r3, r4]) AS raw FROM mail) WHERE raw IS NOT NULL),
hop1 AS (SELECT k, org_id, seq, raw,
  nullif(lower(rtrim(regexp_extract(raw, '(?is)\bfrom\s+([^\s(;]+)', 1), '.')), '') AS helo,
  nullif(lower(regexp_extract(raw, '(?is)\bfrom\s+[^\s(;]+\s*\(\s*([A-Za-z0-9._-]+)?\s*[\[(]', 1)), '') AS rdns_claim,
  nullif(lower(rtrim(regexp_extract(raw, '(?is)\bby\s+([^\s(;]+)', 1), '.')), '') AS by_host,
  nullif(regexp_extract(raw, '(?is)\bwith\s+([A-Za-z0-9/_.-]+)', 1), '') AS protocol,
  nullif(regexp_extract(raw, '(?is)\bid\s+([^\s;]+)', 1), '') AS queue_id,
  nullif(regexp_extract(raw, '(?is)\((version=TLS[^)]*)\)', 1), '') AS tls_info,
  list_filter(list_transform(flatten(list_transform(regexp_extract_all(string_split_regex(raw, '(?i)\sby\s')[1], '[\[(]([^\])]{2,})[\])]', 1),
      lambda c: regexp_extract_all(c, '(?i)(?:IPv6:)?([0-9a-f:.]{3,45})', 1))),
      lambda x: regexp_replace(lower(trim(x, '.:')), '(^|:)0+([0-9a-f])', '\1\2', 'g')),
    lambda x: regexp_matches(x, '__V4__') OR regexp_matches(x, '^[0-9a-f]{1,4}(:[0-9a-f]{0,4}){2,7}$'))[1] AS observed_ip,
  make_timestamp(2026, 9, CAST(regexp_extract(raw, '; \w+, (\d+) Sep', 1) AS INT), CAST(regexp_extract(raw, ' (\d\d):\d\d:\d\d ', 1) AS INT),
      CAST(regexp_extract(raw, ' \d\d:(\d\d):\d\d ', 1) AS INT), CAST(regexp_extract(raw, ' \d\d:\d\d:(\d\d) ', 1) AS DOUBLE))
    - to_minutes(__ZONE__) AS hop_ts_utc
  FROM hop0),
hop2 AS (SELECT *, __CLASS__ AS ip_class,
  CASE WHEN __ORG__ THEN 'org_internal' WHEN __PROV__ THEN 'trusted_provider' WHEN __RDNS__ THEN 'trusted_provider' ELSE 'external' END AS role
  FROM hop1),
bound AS (SELECT m.k, m.org_id, count(h.seq) AS n_hops, CASE WHEN count(h.seq) = 0 THEN NULL
    WHEN min(h.seq) FILTER (role = 'external') IS NULL THEN max(h.seq)
    WHEN min(h.seq) FILTER (role = 'external') = 0 THEN NULL ELSE min(h.seq) FILTER (role = 'external') - 1 END AS boundary_seq
  FROM mail m LEFT JOIN hop2 h ON h.k = m.k GROUP BY m.k, m.org_id),
late AS (SELECT k, seq FROM (SELECT k, seq, hop_ts_utc, lead(hop_ts_utc) OVER (PARTITION BY k ORDER BY seq) AS older FROM hop2 WHERE hop_ts_utc IS NOT NULL)
  WHERE hop_ts_utc + INTERVAL 5 MINUTE < older),
brk AS (SELECT k, seq FROM (SELECT k, seq, by_host, lag(helo) OVER (PARTITION BY k ORDER BY seq) AS claimed FROM hop2)
  WHERE claimed IS NOT NULL AND by_host IS NOT NULL AND NOT ends_with(claimed, by_host) AND NOT ends_with(by_host, claimed)),
priv AS (SELECT h.k, h.seq FROM hop2 h JOIN bound b ON b.k = h.k WHERE h.seq > b.boundary_seq AND h.ip_class IN ('private', 'loopback')
  AND EXISTS (SELECT 1 FROM hop2 o WHERE o.k = h.k AND o.seq > h.seq AND o.ip_class = 'public')),
hop3 AS (SELECT h.*, b.boundary_seq, list_filter([CASE WHEN l.seq IS NOT NULL THEN 'timestamp_not_monotonic' END,
    CASE WHEN x.seq IS NOT NULL THEN 'handoff_discontinuity' END, CASE WHEN p.seq IS NOT NULL THEN 'private_ip_after_public' END], lambda a: a IS NOT NULL) AS anomalies,
  CASE WHEN h.seq < b.boundary_seq THEN 'vouched' WHEN h.seq = b.boundary_seq THEN 'boundary' WHEN l.seq IS NOT NULL THEN 'forged' ELSE 'asserted' END AS trust_state
  FROM hop2 h JOIN bound b ON b.k = h.k LEFT JOIN late l ON l.k = h.k AND l.seq = h.seq LEFT JOIN brk x ON x.k = h.k AND x.seq = h.seq
  LEFT JOIN priv p ON p.k = h.k AND p.seq = h.seq),
ar AS (SELECT * FROM (SELECT k, dom, unnest([1, 2]) AS idx, unnest([ar1, ar2]) AS header FROM mail) WHERE header IS NOT NULL),
ar1_ AS (SELECT *, nullif(lower(regexp_extract(header, '^\s*([A-Za-z0-9._-]+)\s*(?:;|$)', 1)), '') AS authserv FROM ar),
ar2_ AS (SELECT *, __TRUST__ AS known, min(CASE WHEN __TRUST__ THEN idx END) OVER (PARTITION BY k) AS trusted_idx FROM ar1_),
arp AS (SELECT k, dom, idx, header, authserv, idx = coalesce(trusted_idx, -1) AS trusted,
  unnest(regexp_extract_all(header, '(?i)\b(spf|dkim|dmarc|arc)\s*=\s*([a-z]+)', 1)) AS mech,
  unnest(regexp_extract_all(header, '(?i)\b(spf|dkim|dmarc|arc)\s*=\s*([a-z]+)', 2)) AS res,
  unnest(range(0, len(regexp_extract_all(header, '(?i)\b(spf|dkim|dmarc|arc)\s*=\s*([a-z]+)', 1)))) AS position FROM ar2_),
auth AS (SELECT k, position, lower(mech) AS mechanism, CASE WHEN list_contains(__RESULTS__, lower(res)) THEN lower(res) ELSE 'none' END AS result_reported,
  authserv AS authserv_id, trusted, nullif(regexp_extract(header, '(?i)header\.s\s*=\s*([A-Za-z0-9._-]+)', 1), '') AS selector,
  nullif(lower(regexp_extract(header, '(?i)header\.d\s*=\s*([A-Za-z0-9._-]+)', 1)), '') AS d_domain,
  CASE lower(mech) WHEN 'dkim' THEN __R1__ = __RD__ WHEN 'spf' THEN __R2__ = __RD__ WHEN 'dmarc' THEN __R3__ = __RD__ END AS aligned FROM arp),
authsum AS (SELECT m.k, coalesce(bool_or(NOT a.trusted AND a.result_reported = 'pass'), false) AS forged,
  coalesce(bool_or(a.trusted AND a.mechanism IN ('dmarc', 'dkim') AND a.result_reported = 'pass' AND a.aligned), false) AS dmarc_aligned,
  count(*) FILTER (a.trusted) AS n_trusted, any_value(a.authserv_id) FILTER (a.trusted) AS trusted_authserv_id FROM mail m LEFT JOIN auth a ON a.k = m.k GROUP BY m.k),
origin AS (SELECT b.k, b.org_id, b.n_hops, b.boundary_seq, s.forged, s.dmarc_aligned, s.n_trusted, s.trusted_authserv_id,
  (SELECT arg_min(h.observed_ip, h.seq) FROM hop2 h WHERE h.k = b.k AND h.seq >= b.boundary_seq AND h.ip_class = 'public' AND h.observed_ip IS NOT NULL) AS feos_ip,
  b.k IN (SELECT k FROM late) AS late, b.k IN (SELECT k FROM brk) AS brk, b.k IN (SELECT k FROM priv) AS priv,
  (SELECT arg_min(h.by_host, h.seq) FROM hop2 h WHERE h.k = b.k AND h.seq = b.boundary_seq) AS boundary_host,
  coalesce((SELECT bool_or(contains(h.rdns_claim, e.m)) FROM hop2 h, (SELECT unnest(__ESP__) AS m) e WHERE h.k = b.k), false) AS esp
  FROM bound b JOIN authsum s ON s.k = b.k),
conf AS (SELECT *, CASE WHEN n_hops = 0 THEN [{'term': 'no_received_headers', 'value': -40}] ELSE list_filter([{'term': 'base', 'value': 50},
    CASE WHEN boundary_seq IS NULL THEN {'term': 'no_trusted_receiving_infrastructure', 'value': -35} ELSE {'term': 'boundary_at_recognised_infrastructure', 'value': 20} END,
    CASE WHEN brk THEN {'term': 'handoff_discontinuity', 'value': -10} ELSE {'term': 'handoff_continuity_intact', 'value': 10} END,
    CASE WHEN late THEN {'term': 'forged_header_below_boundary', 'value': -10} ELSE {'term': 'timestamps_monotonic', 'value': 10} END,
    CASE WHEN feos_ip IS NULL THEN {'term': 'no_public_sender_observed', 'value': -20} END,
    CASE WHEN forged THEN {'term': 'injected_authentication_results', 'value': -5} END,
    CASE WHEN n_hops < 2 THEN {'term': 'single_hop_nothing_to_corroborate', 'value': -8} END,
    CASE WHEN esp THEN {'term': 'shared_esp_true_origin_unrecoverable', 'value': -12} END], lambda x: x IS NOT NULL) END AS terms,
  CASE WHEN n_hops = 0 THEN ['no_received_headers'] ELSE list_filter([CASE WHEN late THEN 'timestamp_not_monotonic' END, CASE WHEN brk THEN 'handoff_discontinuity' END,
    CASE WHEN priv THEN 'private_ip_after_public' END, CASE WHEN forged THEN 'forged_authentication_results' END], lambda x: x IS NOT NULL) END AS flags FROM origin),
orig AS (SELECT *, CASE WHEN n_hops = 0 THEN 10 ELSE greatest(5, least(95, list_sum(list_transform(terms, lambda t: t.value)))) END AS confidence FROM conf)
"""

_URLS = r"""
content AS (SELECT m.*, CASE WHEN kind = 3 THEN regexp_replace(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '[ \t\x{a0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g') ELSE body END AS text_body,
  CASE WHEN kind = 3 THEN body ELSE '' END AS html_body FROM mail m),
urls AS (SELECT k, list_transform(list_concat(list_concat(regexp_extract_all(text_body, '__URL__', 1), regexp_extract_all(html_body, '__URL__', 1)),
    list_filter(regexp_extract_all(html_body, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1), lambda h: regexp_matches(lower(h), '^(https?|hxxps?)://'))),
  lambda u: rtrim(replace(replace(u, 'hxxp', 'http'), '[.]', '.'), '.,;)>"''')) AS found FROM content),
urlr AS (SELECT k, url, min(i) AS first_at FROM (SELECT k, unnest(found) AS url, unnest(range(0, len(found))) AS i FROM urls) GROUP BY k, url),
urlp AS (SELECT k, url, row_number() OVER (PARTITION BY k ORDER BY first_at) - 1 AS position FROM urlr)
"""


def _rules() -> str:
    """Finding rows (k, ord, signal_group, rule_id, severity, title, evidence_ref, quote, mitre)."""
    out = []

    def add(ord_, rule, source, where, *, ref="NULL", quote="NULL", title=None, severity=None, rule_sql=None):
        group, sev, text, mitre = fv.RULES[rule] if rule in fv.RULES else (None,) * 4
        if rule.startswith("CONTENT"):
            entry = next(e for e in fv.CONTENT_LEXICON if e[0] == rule)
            group, sev, text, mitre = "content", entry[2], entry[1], None
        out.append(
            f"SELECT k, {ord_} AS ord, {lit(group)} AS signal_group, {rule_sql or lit(rule)} AS rule_id, "
            f"{severity or lit(sev)} AS severity, {title or lit(text)} AS title, {ref} AS evidence_ref, "
            f"{quote} AS evidence_quote, {lit(mitre)} AS mitre_technique FROM {source} WHERE {where}"
        )

    full = "x"
    aref = "'Authentication-Results (' || trusted_authserv_id || ')'"
    add(0, "AUTH_INJECTED_RESULTS", full, "forged", ref="'Authentication-Results'")
    add(1, "AUTH_NO_TRUSTED_RESULTS", full, "n_trusted = 0", ref="'Authentication-Results'")
    per = "(SELECT a.*, x.dmarc_aligned, x.trusted_authserv_id FROM auth a JOIN x ON x.k = a.k WHERE a.trusted)"
    add("2 + position", "AUTH_%s_PASS_UNALIGNED", per, "result_reported = 'pass' AND aligned = false AND NOT dmarc_aligned",
        ref=aref, title="upper(mechanism) || ' passed, but not for the identity shown to the recipient'",
        rule_sql="'AUTH_' || upper(mechanism) || '_PASS_UNALIGNED'")
    add("2 + position", "AUTH_%s_FAIL", per, "result_reported IN ('fail', 'softfail')", ref=aref,
        title="upper(mechanism) || ' failed'", rule_sql="'AUTH_' || upper(mechanism) || '_FAIL'")
    add("2 + position", "AUTH_DMARC_ALIGNED_ESTABLISHED", per, "result_reported = 'pass' AND aligned AND mechanism = 'dmarc'",
        ref="'Authentication-Results'")
    add(20, "IDENT_DUPLICATE_FROM", full, "from2 IS NOT NULL", ref="'From'")
    add(21, "IDENT_INVISIBLE_CHARS", full, "contains(display, '\u200b')", ref="display")
    name = f"list_filter({strs(CONFIG.protected_identities)}, lambda p: contains(lower(display), lower(p)))[1]"
    add(22, "IDENT_PROTECTED_DISPLAY_NAME", full, f"{name} IS NOT NULL", ref="display",
        title=f"'Display name claims a protected identity: ' || {name}")
    p = CONFIG.protected_domains[0]
    skeleton = "translate(dom, '015', 'ols')"
    add(23, "IDENT_LOOKALIKE_DOMAIN", full, f"dom <> {lit(p)} AND (contains(dom, {lit(p.split('.')[0])}) OR damerau_levenshtein({skeleton}, {lit(p)}) <= 3)",
        ref=f"dom || ' ~ ' || {lit(p)}", title=lit(f"Sender domain resembles a protected domain ({p})"))
    rdom = "split_part(reply_to, '@', 2)"
    add(24, "IDENT_REPLY_TO_DIVERGENT", full, f"reply_to IS NOT NULL AND {rdom} <> dom", ref=f"'From: ' || dom || ' / Reply-To: ' || {rdom}")
    add(25, "IDENT_REPLY_TO_FREEMAIL", full, f"reply_to IS NOT NULL AND list_contains({strs(fv.FREEMAIL_DOMAINS)}, {rdom})", ref=f"'Reply-To: ' || {rdom}")
    bdom = "split_part(return_path, '@', 2)"
    add(26, "IDENT_RETURN_PATH_DIVERGENT", full, f"return_path IS NOT NULL AND NOT dmarc_aligned AND ({registrable_sql(bdom)}) <> ({registrable_sql('dom')})",
        ref="'Return-Path: ' || return_path")
    add(30, "INFRA_FORGED_RECEIVED", full, "late", ref="'Received chain'")
    add(31, "INFRA_HANDOFF_BREAK", full, "brk", ref="'Received chain'")
    add(32, "INFRA_NO_TRUST_BOUNDARY", full, "n_hops > 0 AND boundary_seq IS NULL", ref="'Received chain'")
    below = "(n_hops - 1 - boundary_seq)"
    add(33, "INFRA_ASSERTED_HOPS", full, f"feos_ip IS NOT NULL AND {below} > 0",
        ref="'hops ' || (boundary_seq + 1) || '..' || (n_hops - 1)", title=f"{below} || ' Received header(s) below the trust boundary'")
    marked = f"""(SELECT u.k, u.url, x.dmarc_aligned AS al, coalesce(({registrable_sql(host_sql('u.url'))}) = ({registrable_sql('x.dom')}), false) AS own
      FROM urlp u JOIN x ON x.k = u.k JOIN (SELECT k, min(position) AS p FROM urlp WHERE position < 50 AND len(list_filter({strs(fv.CREDENTIAL_URL_MARKERS)}, lambda m: contains(lower(url), m))) > 0 GROUP BY k) f
      ON f.k = u.k AND f.p = u.position)"""
    add(40, "URL_CREDENTIAL_LANDING", marked, "true", ref="url", severity="CASE WHEN own AND al THEN 'low' WHEN own THEN 'medium' ELSE 'high' END")
    like = f"""(SELECT u.k, u.url FROM urlp u JOIN (SELECT k, min(position) AS p FROM urlp WHERE position < 50 AND {host_sql('url')} <> {lit(p)}
      AND contains({host_sql('url')}, {lit(p.split('.')[0])}) GROUP BY k) f ON f.k = u.k AND f.p = u.position)"""
    add(41, "URL_LOOKALIKE_HOST", like, "true", ref="url", title=lit(f"Link host imitates a protected domain ({p})"))
    add(50, "ATTACH_TYPE_MISMATCH", full, "kind = 6", ref="sha256(att_payload)", title="'Attachment extension disagrees with its declared type: ' || att_name")
    add(50, "ATTACH_ARCHIVE", full, "kind = 5", ref="sha256(att_payload)", title="'Archive attachment: ' || att_name")
    add(50, "ATTACH_PRESENT", full, "kind IN (0, 1)", ref="sha256(att_payload)", title="'Attachment: ' || att_name")
    for i, (rule, _, _, terms) in enumerate(fv.CONTENT_LEXICON):
        hit = f"list_filter({strs(terms)}, lambda t: contains(lower(text_body), t))[1]"
        at = f"strpos(lower(text_body), {hit})"
        cut = f"substr(text_body, greatest({at} - 60, 1), {at} + length({hit}) + 60 - greatest({at} - 60, 1))"
        add(60 + i, rule, full, f"{hit} IS NOT NULL", quote=f"regexp_replace(replace({cut}, chr(10), ' '), '^\\s+|\\s+$', '', 'g')")
    return (
        "x AS (SELECT c.*, o.* EXCLUDE (k, org_id) FROM content c JOIN orig o ON o.k = c.k), f0 AS ("
        + " UNION ALL ".join(out) + ")"
    )


def _scores() -> str:
    weights = ", ".join(f"({lit(g)}, {w})" for g, w in fv.GROUP_WEIGHTS.items())
    severities = ", ".join(f"({lit(s)}, {w})" for s, w in fv.SEVERITY_WEIGHTS.items())
    offline = strs(fv.OFFLINE_GROUPS)
    det = strs(fv.DETERMINISTIC_GROUPS)
    return f"""
gw AS (SELECT * FROM (VALUES {weights}) v(signal_group, weight)), sw AS (SELECT * FROM (VALUES {severities}) v(severity, sev)),
fnd AS (SELECT f.*, sw.sev, gw.weight, count(*) OVER (PARTITION BY f.k, f.signal_group) AS n_group,
  CAST(round_even(sw.sev * gw.weight / count(*) OVER (PARTITION BY f.k, f.signal_group), 2) AS DOUBLE) AS score_contribution
  FROM f0 f JOIN sw USING (severity) JOIN gw USING (signal_group)),
gs AS (SELECT k, signal_group, any_value(weight) AS weight, count(*) AS n, CAST(round_even(least(1.0, list_reduce(list_prepend(0.0::DOUBLE, list(sev::DOUBLE ORDER BY sev DESC)),
    lambda s, m: CASE WHEN s = 0 THEN m ELSE s + m * (1.0 - s) * 0.5 END)), 4) AS DOUBLE) AS score FROM fnd GROUP BY k, signal_group),
gc AS (SELECT k, signal_group, weight, n, score, CAST(round_even(score * weight, 2) AS DOUBLE) AS contribution FROM gs),
rules AS (SELECT k, list(rule_id) AS ids FROM fnd GROUP BY k),
s0 AS (SELECT m.k, coalesce(sum(contribution), 0) AS raw, coalesce(sum(contribution) FILTER (signal_group = 'content'), 0) AS content_part,
  count(*) FILTER (score >= 0.7) AS strong, count(*) FILTER (score >= 0.7 AND list_contains({det}, signal_group)) AS strong_det,
  list(signal_group ORDER BY signal_group) FILTER (score >= 0.7) AS strong_names,
  coalesce(max(score) FILTER (signal_group = 'authentication'), 0) AS s_auth, coalesce(max(score) FILTER (signal_group = 'attachment'), 0) AS s_att
  FROM mail m LEFT JOIN gc ON gc.k = m.k GROUP BY m.k),
s1 AS (SELECT s0.*, coalesce(ids, []) AS ids, raw / 82 * 100 AS base0, (raw - content_part) / 70 * 100 AS non_content FROM s0 LEFT JOIN rules r ON r.k = s0.k),
s2 AS (SELECT *, non_content < 65 AND base0 > 65 AS ceil_hit, CASE WHEN non_content < 65 AND base0 > 65 THEN 65 ELSE base0 END AS base1, strong >= 2 AND strong_det >= 1 AS corroborated,
  list_contains(ids, 'IDENT_PROTECTED_DISPLAY_NAME') OR list_contains(ids, 'IDENT_LOOKALIKE_DOMAIN') AS imp FROM s1),
s3 AS (SELECT *, NOT corroborated AND base1 > 84 AS capped, list_contains(ids, 'AUTH_DMARC_ALIGNED_ESTABLISHED') AND NOT imp AS damp FROM s2),
s4 AS (SELECT *, CAST(greatest(0, least(100, round_even(CASE WHEN capped THEN 84 ELSE base1 END + CASE WHEN damp THEN -12 ELSE 0 END, 0))) AS BIGINT) AS score FROM s3),
s5 AS (SELECT *, CASE WHEN score <= 19 THEN 'benign' WHEN score <= 39 THEN 'suspicious' WHEN score <= 64 THEN 'likely_malicious' WHEN score <= 84 THEN 'high' ELSE 'critical' END AS band FROM s4),
sc AS (SELECT *, CASE WHEN band = 'benign' THEN 'benign' WHEN imp AND list_contains(ids, 'CONTENT_FINANCIAL') AND s_auth >= 0.5 THEN 'bec'
  WHEN list_contains(ids, 'URL_CREDENTIAL_LANDING') THEN 'credential_phishing' WHEN s_att >= 0.7 THEN 'malware_delivery' WHEN imp THEN 'impersonation'
  WHEN band IN ('high', 'critical') THEN 'phishing' ELSE 'unknown' END AS classification,
  concat_ws(' | ', 'normalised over 82/100 available weight; not evaluated: campaign, threat_intel',
    CASE WHEN ceil_hit THEN 'ai_ceiling: deterministic evidence alone scores ' || CAST(CAST(round_even(non_content, 0) AS BIGINT) AS VARCHAR) || ', below 65; social-engineering signals cannot carry a case past that on their own' END,
    CASE WHEN capped THEN 'corroboration_gate: capped at 84 -- a Critical verdict needs 2 independent groups >= 0.7, at least 1 deterministic (found ' || strong || ' / ' || strong_det || ')'
      WHEN corroborated THEN 'corroboration_gate: satisfied by ' || strong || ' groups (' || array_to_string(strong_names, ', ') || ')' END,
    CASE WHEN damp THEN 'legitimacy_dampener: -12 (DMARC aligned to an established domain, no impersonation signal)' END) AS controls FROM s5)
""" + f"/* evaluated: {len(offline)} */"


def _fill(sql: str, zone: str = _ZONE) -> str:
    reg = {
        "__ZONE__": zone,
        "__R1__": last_two("regexp_extract(header, '(?i)header\\.d\\s*=\\s*([A-Za-z0-9._-]+)', 1)"),
        "__R2__": last_two("regexp_replace(regexp_extract(header, '(?i)smtp\\.mailfrom\\s*=\\s*([A-Za-z0-9._@-]+)', 1), '^.*@', '')"),
        "__R3__": last_two("regexp_extract(header, '(?i)header\\.from\\s*=\\s*([A-Za-z0-9._-]+)', 1)"),
        "__RD__": last_two("dom"),
        "__V4__": _V4,
        "__CLASS__": ip_class_sql("observed_ip"),
        "__ORG__": suffix_of("by_host", CONFIG.protected_domains),
        "__PROV__": suffix_of("by_host", PROVIDERS),
        "__RDNS__": "rdns_claim IS NOT NULL AND " + suffix_of("rdns_claim", PROVIDERS),
        "__TRUST__": "authserv IS NOT NULL AND " + suffix_of("authserv", CONFIG.trusted_authserv),
        "__RESULTS__": strs(fv.AUTH_RESULTS),
        "__ESP__": strs(fv.SHARED_ESP_MARKERS),
        "__URL__": fv.URL_PATTERN.replace("'", "''").replace(r"\b(", r"(?i)\b(", 1),
    }
    # an absent identifier leaves alignment undecided
    for mark, pattern in (("__R1__", "header\\.d"), ("__R2__", "smtp\\.mailfrom"), ("__R3__", "header\\.from")):
        reg[mark] = f"CASE WHEN regexp_matches(header, '(?i){pattern}\\s*=\\s*[A-Za-z0-9]') THEN {reg[mark]} END"
    for mark, text in reg.items():
        sql = sql.replace(mark, text)
    return sql


def mail_with(final: str, level: str = "score", zone_at_end: bool = False) -> str:
    """A full statement: the CTEs up to ``level`` and a final SELECT."""
    parts = [mail_ctes("duckdb")]
    if level != "mail":
        parts.append(_fill(_HOP, _ZONE_AT_END if zone_at_end else _ZONE))
    if level in ("content", "rules", "score"):
        parts.append(_fill(_URLS))
    if level in ("rules", "score"):
        parts.append(_rules())
    if level == "score":
        parts.append(_scores())
    return f"WITH RECURSIVE {', '.join(parts)} {final}"
