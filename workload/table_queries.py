"""Operators applied directly to the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions import canonical, net, similarity, text
from relaytrail.operators import access, attribution, guard, numbering, quality, responses, rules
from workload.context import Context
from workload.link_queries import _ENTROPY, _TOKENS, shape, simhash_ctes
from workload.mail_view import spread
from workload.oracle_base import ip_class_sql, last_two, lit, strs
from workload.registry import query

URL = r"\b((?:https?|ftp)://[^\s<>\"''\])}]+|hxxps?://[^\s<>\"''\])}]+)".replace('\\"', '"')


# ------------------------------------------------------------------ text ---
@query("content_simhash", f"""WITH tk AS (SELECT doc_id, {_TOKENS.replace('text_body', 'text')} AS tokens FROM documents), {simhash_ctes('tk', 'doc_id', 'tokens')}
  SELECT d.doc_id, coalesce(x.token_count, 0) AS token_count, coalesce(x.simhash, '0000000000000000') AS simhash FROM documents d LEFT JOIN sx x ON x.doc_id = d.doc_id""")
def _(c: Context) -> DataFrame:
    tokens = spread(c.table("documents").select("doc_id", "text")).select("doc_id", text.content_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("token_count"), similarity.hex16(similarity.simhash64(F.col("t"))).alias("simhash"))


@query("hamming_neighbours", f"""WITH tk AS (SELECT doc_id, {_TOKENS.replace('text_body', 'text')} AS tokens FROM documents), {simhash_ctes('tk', 'doc_id', 'tokens')},
  z AS (SELECT d.doc_id, coalesce(x.simhash, '0000000000000000') AS s FROM documents d LEFT JOIN sx x ON x.doc_id = d.doc_id)
  SELECT a.doc_id, 1 - (bit_count(xor(CAST('0x' || substr(a.s, 1, 8) AS BIGINT), CAST('0x' || substr(b.s, 1, 8) AS BIGINT))) + bit_count(xor(CAST('0x' || substr(a.s, 9, 8) AS BIGINT), CAST('0x' || substr(b.s, 9, 8) AS BIGINT)))) / 64.0 AS sim
  FROM z a JOIN z b ON b.doc_id = a.doc_id + 1""")
def _(c: Context) -> DataFrame:
    documents = c.table("documents").select("doc_id", "text")
    docs = spread(documents, documents.count())
    # both sides of the join read the sketches, so they are stored: two longs a document
    h = c.shared("document_sketches", lambda: docs.select("doc_id", similarity.simhash64(text.content_tokens(F.col("text"))).alias("h")))
    after = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g"))
    return h.join(after, "doc_id").select("doc_id", similarity.hamming_similarity(F.col("h"), F.col("g")).alias("sim"))


@query("word_jaccard", """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents)
  SELECT a.doc_id, round(coalesce(len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 0.0), 6) AS sim FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def _(c: Context) -> DataFrame:
    docs = spread(c.table("documents").select("doc_id", "text"))
    words = docs.select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("w"))
    after = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return words.join(after, "doc_id").select("doc_id", F.round(similarity.jaccard(F.col("w"), F.col("v")), 6).alias("sim"))


LEXICON = (
    ("CONTENT_URGENCY", "Urgency pressure", "medium", ("immediat", "und", "ertion")),
    ("CONTENT_AUTHORITY", "Authority pressure", "medium", ("which", "elle", "license")),
    ("CONTENT_SECRECY", "Request for secrecy", "high", ("secret", "token", "ción")),
    ("CONTENT_FINANCIAL", "Financial instruction", "medium", ("000", "@mail")),
    ("CONTENT_CREDENTIAL", "Credential solicitation", "medium", ("keit", "pass", "###")),
)


def _lexical_oracle() -> str:
    parts = []
    for rule, _, severity, terms in LEXICON:
        hit = f"list_filter({strs(terms)}, lambda t: contains(lower(text), t))[1]"
        at = f"strpos(lower(text), {hit})"
        cut = f"substr(text, greatest({at} - 60, 1), {at} + length({hit}) + 60 - greatest({at} - 60, 1))"
        parts.append(
            f"SELECT doc_id, {lit(rule)} AS rule_id, {lit(severity)} AS severity, regexp_replace(replace({cut}, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS evidence_quote FROM documents WHERE {hit} IS NOT NULL")
    return " UNION ALL ".join(parts)


@query("lexical_findings", _lexical_oracle())
def _(c: Context) -> DataFrame:
    docs = spread(c.table("documents").select("doc_id", "text"))
    found = docs.select("doc_id", F.inline(rules.content_rules(F.col("text"), LEXICON)))
    return found.select("doc_id", "rule_id", "severity", "evidence_quote")


@query("text_facts", r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS value, 'ip' AS kind FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b[0-9a-f]{32,64}\b')), 'hash' FROM documents) SELECT doc_id, kind, lower(value) AS value, count(*) AS n FROM f GROUP BY ALL""")
def _(c: Context) -> DataFrame:
    docs = spread(c.table("documents").select("doc_id", "text"))
    ip_pattern, _, hash_pattern = fv.FACT_PATTERNS

    def found(kind: str, pattern: str) -> DataFrame:
        values = F.regexp_extract_all("text", F.lit(pattern), 0)
        return docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.transform(values, F.lower)).alias("value"))

    return found("ip", ip_pattern).unionByName(found("hash", hash_pattern)).groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


@query("fact_redaction", r"""WITH known AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), lambda x: lower(x)), lambda x, i: i % 2 = 0) AS k, text FROM documents),
  f AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'), lambda m: NOT list_contains(k, lower(m))) AS gone FROM known)
  SELECT doc_id, len(gone) AS stripped FROM f WHERE len(gone) > 0""")
def _(c: Context) -> DataFrame:
    """Addresses in documents, every second one known; only the address pattern is counted."""
    docs = spread(c.table("documents").select("doc_id", "text"))
    found = F.regexp_extract_all("text", F.lit(fv.FACT_PATTERNS[0]), 0)
    known = docs.select("doc_id", "text", F.filter(F.transform(found, F.lower), lambda _, i: i % 2 == 1).alias("known"))
    redacted = known.select("doc_id", guard.redact_unknown_facts(F.col("text"), F.col("known")).alias("r"))
    stripped = F.filter("r.stripped", lambda v: v.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"))
    return redacted.select("doc_id", F.size(stripped).alias("stripped")).where("stripped > 0")


@query("forbidden_claims", f"""WITH t AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN '. The attacker is in Paris. Stay calm' WHEN 1 THEN '. It Travelled Through ten hosts' ELSE '' END AS x FROM conversations),
  s AS (SELECT conv_id, turn, x, string_split(x, '. ') AS parts FROM t)
  SELECT conv_id, turn, sha256(trim(CASE WHEN turn % 3 = 2 THEN x ELSE array_to_string(list_filter(parts, lambda p: NOT contains(lower(p), 'the attacker is in') AND NOT contains(lower(p), 'travelled through')), '. ') || {lit(fv.FORBIDDEN_NOTICE)} END)) AS digest,
  CASE WHEN turn % 3 = 2 THEN 0 ELSE 1 END AS violations FROM s""")
def _(c: Context) -> DataFrame:
    tail = F.when(F.col("turn") % 3 == 0, ". The attacker is in Paris. Stay calm").when(F.col("turn") % 3 == 1, ". It Travelled Through ten hosts").otherwise("")
    told = c.table("conversations").select("conv_id", "turn", guard.check_claims(F.concat("text", tail)).alias("c"))
    return told.select("conv_id", "turn", F.sha2("c.text", 256).alias("digest"), F.size("c.violations").alias("violations"))


@query("quote_grounding", """WITH p AS (SELECT a.conv_id, a.turn, a.text AS body, CASE WHEN a.turn % 2 = 0 THEN '  ' || substr(a.text, 3, 40) ELSE substr(b.text, 1, 40) || ' no' END AS quote FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
  SELECT conv_id, turn, contains(lower(trim(regexp_replace(body, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\\s+', ' ', 'g')))) AS grounded FROM p""".replace("\\\\", "\\"))
def _(c: Context) -> DataFrame:
    a = c.table("conversations").select("conv_id", "turn", F.col("text").alias("body"))
    b = c.table("conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    quote = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), F.substring("body", 3, 40))).otherwise(F.concat(F.substring("next", 1, 40), F.lit(" no")))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", guard.quote_grounded(F.col("body"), quote).alias("grounded"))


@query("grounding_ratio", """WITH q AS (SELECT role, conv_id, turn, [substr(text, 1, 20), 'never said this', substr(text, 5, 10)] AS quotes, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS body FROM conversations),
  g AS (SELECT role, len(list_filter(quotes, lambda x: x <> '' AND contains(body, lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))))) AS kept FROM q)
  SELECT role, sum(3 - kept)::BIGINT AS quotes_dropped, sum(kept)::BIGINT AS quotes_validated, round(sum(3 - kept) / sum(kept), 6) AS dropped_ratio FROM g GROUP BY role""".replace("\\\\", "\\"))
def _(c: Context) -> DataFrame:
    rows = c.table("conversations").withColumn("case_id", F.concat_ws("-", "conv_id", "turn"))

    def signal(quote) -> F.Column:
        return F.struct(F.lit("urgency").alias("type"), F.lit("low").alias("level"), quote.alias("quote"))

    claim = F.lit(None).cast("struct<name:string,quote:string>")
    outputs = rows.select(
        "case_id", "role",
        F.array(signal(F.substring("text", 1, 20)), signal(F.lit("never said this")), signal(F.substring("text", 5, 10))).alias("signals"),
        claim.alias("impersonated_entity"), claim.alias("requested_action"))
    grounded = guard.ground_extractions(outputs, rows.select("case_id", F.col("text").alias("text_body")))
    return guard.grounding_ratio(grounded, "role").withColumn("dropped_ratio", F.round("dropped_ratio", 6))


@query("model_output_records", """SELECT conv_id, turn, 'extract' AS call_kind, sha256(text) AS output_sha256, length(text) % 3 AS quotes_dropped FROM conversations WHERE role = 'assistant'""")
def _(c: Context) -> DataFrame:
    answers = c.table("conversations").where("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", "turn").alias("case_id"), F.sha2(F.col("text"), 256).alias("input_sha256"), F.col("text").alias("response"),
        F.lit(1).alias("quotes_validated"), (F.length("text") % 3).alias("quotes_dropped"), F.lit(False).alias("prompt_injection_detected"))
    return responses.output_records(answers, "m1", "v1").select(
        F.substring_index("case_id", "-", 1).cast("long").alias("conv_id"), F.substring_index("case_id", "-", -1).cast("long").alias("turn"),
        "call_kind", "output_sha256", "quotes_dropped")


# ------------------------------------------------------------------ pages ---
_HOST = "split_part(split_part(regexp_replace(lower(url), '^.*?//', ''), '/', 1), ':', 1)"


@query("url_shapes", f"""SELECT page_id, {_HOST} AS host, {shape("split_part(CASE WHEN contains(regexp_replace(url, '^.*?//', ''), '/') THEN regexp_replace(regexp_replace(url, '^.*?//', ''), '^[^/]*', '') ELSE '/' END, '?', 1)")} AS path_shape,
  array_to_string(string_split({_HOST}, '.')[-2:], '.') AS suffix FROM pages""")
def _(c: Context) -> DataFrame:
    url = F.col("url")
    return c.table("pages").select(
        "page_id", net.url_host(url).alias("host"), text.char_shape(net.url_path(url)).alias("path_shape"),
        net.host_suffix(net.url_host(url), 2).alias("suffix"))


@query("host_names", f"""WITH h AS (SELECT page_id, {_HOST} AS host, split_part({_HOST}, '.', 1) AS label FROM pages)
  SELECT page_id, length(label) AS label_length, round({_ENTROPY.format('label')}, 6) AS entropy, len(string_split(host, '.')) AS labels, array_to_string(list_sort(list_distinct(list_transform(range(1, length(label) - 1), lambda i: substr(label, i, 3)))), ',') AS trigrams FROM h""")
def _(c: Context) -> DataFrame:
    hosts = c.table("pages").select("page_id", net.url_host(F.col("url")).alias("host"))
    label = F.substring_index("host", ".", 1)
    features = text.name_features(F.col("host"))
    return hosts.select(
        "page_id", features[0].cast("long").alias("label_length"), F.round(text.shannon_entropy(label), 6).alias("entropy"),
        features[4].cast("long").alias("labels"), F.array_join(text.trigrams(label), ",").alias("trigrams"))


@query("html_text", r"""SELECT page_id, sha256(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\x{a0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages""")
def _(c: Context) -> DataFrame:
    return c.table("pages").select("page_id", F.sha2(text.html_to_text(F.col("html")), 256).alias("digest"))


@query("page_links", f"""WITH u AS (SELECT page_id, list_transform(list_concat(regexp_extract_all(html, '(?i){URL}', 1), list_filter(list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1), lambda h: trim(h)), lambda h: regexp_matches(lower(h), '^(https?|hxxps?)://'))),
   lambda u: rtrim(replace(replace(u, 'hxxp', 'http'), '[.]', '.'), '.,;)>"''')) AS found FROM pages),
  r AS (SELECT page_id, url, min(i) AS first_at FROM (SELECT page_id, unnest(found) AS url, unnest(range(0, len(found))) AS i FROM u) GROUP BY page_id, url)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_at) - 1 AS position, url FROM r""")
def _(c: Context) -> DataFrame:
    return c.table("pages").select("page_id", F.posexplode(text.extract_urls(F.lit(""), F.col("html"))).alias("position", "url"))


@query("registrable_domains", f"""WITH s AS (SELECT unnest(['com', 'org', 'net', 'example.com', 'example.org']) AS suffix), h AS (SELECT page_id, {_HOST} AS host, string_split({_HOST}, '.') AS l FROM pages)
  SELECT page_id, {last_two('host')} AS last_two, coalesce((SELECT arg_min(array_to_string(l[i - 1:], '.'), i) FROM (SELECT unnest(range(2, len(l) + 1)) AS i) x JOIN s ON s.suffix = array_to_string(l[x.i:], '.')), {last_two('host')}) AS listed FROM h""")
def _(c: Context) -> DataFrame:
    suffixes = c.spark.createDataFrame([(s,) for s in ("com", "org", "net", "example.com", "example.org")], "suffix string")
    hosts = c.table("pages").select("page_id", net.url_host(F.col("url")).alias("host"))
    return attribution.with_registrable_domain(hosts, "host", suffixes, "listed").select(
        "page_id", net.last_two_labels(F.col("host")).alias("last_two"), "listed")


# ------------------------------------------------------------------ names, vectors, sequences ---
@query("osa_neighbours", """WITH s AS (SELECT p_partkey, p_name AS n FROM part), p AS (SELECT x.p_partkey, string_split(x.n, '') AS a, string_split(y.n, '') AS b FROM s x JOIN s y ON y.p_partkey = x.p_partkey + 1)
  SELECT p_partkey, list_reduce(list_prepend({'r': range(0, len(b) + 1), 'q': range(0, len(b) + 1), 'i': 0::BIGINT}, list_transform(range(1, len(a) + 1), lambda i: {'r': [0::BIGINT], 'q': [0::BIGINT], 'i': i})),
    lambda st, x: {'r': list_reduce(list_prepend([x.i], list_transform(range(1, len(b) + 1), lambda j: [j])),
      lambda row, c: list_append(row, least(row[-1] + 1, st.r[c[1] + 1] + 1, st.r[c[1]] + CASE WHEN a[x.i] = b[c[1]] THEN 0 ELSE 1 END,
        CASE WHEN x.i > 1 AND c[1] > 1 AND a[x.i] = b[c[1] - 1] AND a[x.i - 1] = b[c[1]] THEN st.q[c[1] - 1] + CASE WHEN a[x.i] = b[c[1]] THEN 0 ELSE 1 END ELSE 999 END))), 'q': st.r, 'i': x.i}).r[-1] AS distance FROM p""")
def _(c: Context) -> DataFrame:
    part = spread(c.table("part")).select("p_partkey", F.col("p_name").alias("n"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("n").alias("m"))
    return part.join(after, "p_partkey").select("p_partkey", similarity.osa_distance(F.col("n"), F.col("m")).alias("distance"))


@query("confusable_skeletons", f"""SELECT c_custkey, translate(lower(c_name), {lit(''.join(fv.CONFUSABLES))}, {lit(''.join(fv.CONFUSABLES.values()))}) AS skeleton FROM customer""")
def _(c: Context) -> DataFrame:
    return c.table("customer").select("c_custkey", text.confusable_skeleton(F.col("c_name"), normalise=True).alias("skeleton"))


@query("cosine_neighbours", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(c: Context) -> DataFrame:
    v = c.table("embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(similarity.cosine(F.col("embedding"), F.col("other")), 5).alias("sim"))


@query("lcs_neighbours", """WITH s AS (SELECT p_partkey, string_split(p_name, '') AS n FROM part), p AS (SELECT x.p_partkey, x.n AS a, y.n AS b FROM s x JOIN s y ON y.p_partkey = x.p_partkey + 1)
  SELECT p_partkey, round(list_reduce(list_prepend({'r': list_transform(range(0, len(b) + 1), lambda z: 0), 'v': ''}, list_transform(a, lambda x: {'r': [0], 'v': x})),
    lambda q, x: {'r': list_reduce(list_prepend([0], list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN b[j] = x.v THEN 1000 + q.r[j] + 1 ELSE q.r[j + 1] END])),
      lambda row, cell: list_append(row, CASE WHEN cell[1] >= 1000 THEN cell[1] - 1000 ELSE greatest(cell[1], row[-1]) END)), 'v': ''}).r[-1] / greatest(len(a), len(b))::DOUBLE, 6) AS ratio FROM p""")
def _(c: Context) -> DataFrame:
    part = spread(c.table("part")).select("p_partkey", F.split("p_name", "").alias("a"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return part.join(after, "p_partkey").select("p_partkey", F.round(similarity.lcs_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


# a group of an IPv6 address has four digits at most: with a larger number the text is no address
_IP = """CASE WHEN event_id % 10 < 2 AND user_id + 1 > 65535 THEN 'not-an-ip-' || user_id WHEN event_id % 10 = 0 THEN '2001:db8:' || lower(to_hex(event_id % 4096 + 1)) || '::' || lower(to_hex(user_id + 1)) WHEN event_id % 10 = 1 THEN 'fe80::' || lower(to_hex(user_id + 1))
  WHEN event_id % 10 = 2 THEN 'not-an-ip-' || user_id ELSE (event_id * 7919) % 256 || '.' || (event_id * 31 + user_id) % 256 || '.' || user_id % 256 || '.' || event_id % 256 END"""


@query("ip_classes", f"""WITH i AS (SELECT event_id, {_IP} AS ip FROM events)
  SELECT event_id, {ip_class_sql('ip')} AS ip_class, CASE WHEN NOT starts_with(ip, 'not') THEN CASE WHEN contains(ip, ':') THEN array_to_string(string_split(ip, ':')[1:3], ':') || '::/48' ELSE array_to_string(string_split(ip, '.')[1:3], '.') || '.0/24' END END AS prefix FROM i""")
def _(c: Context) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")

    def text_of(n) -> F.Column:
        return n.cast("string")

    quad = F.concat_ws(".", text_of(k * 7919 % 256), text_of((k * 31 + u) % 256), text_of(u % 256), text_of(k % 256))
    ip = (
        F.when(k % 10 == 0, F.concat(F.lit("2001:0DB8:"), F.hex(k % 4096 + 1), F.lit(":0:0:0:0:"), F.hex(u + 1)))
        .when(k % 10 == 1, F.concat(F.lit("fe80::0:"), F.hex(u + 1)))
        .when(k % 10 == 2, F.concat(F.lit("not-an-ip-"), text_of(u)))
        .otherwise(quad)
    )
    seen = spread(c.table("events")).select("event_id", ip.alias("ip"))
    return seen.select(
        "event_id", net.ip_class(F.col("ip")).alias("ip_class"), net.ip_prefix(net.ip_canonical(F.col("ip"))).alias("prefix"))


# ------------------------------------------------------------------ records ---
@query("canonical_records", """SELECT o_orderkey, sha256('{"at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') || '","customer":' || o_custkey || ',"note":null,"priority":"' || o_orderpriority || '","total":"' || printf('%.6f', o_totalprice) || '"}') AS digest FROM orders""")
def _(c: Context) -> DataFrame:
    fields = {
        "customer": F.col("o_custkey"), "priority": F.col("o_orderpriority"), "at": canonical.moment(F.col("o_orderdate")),
        "total": canonical.decimal_text(F.col("o_totalprice")), "note": F.lit(None).cast("string")}
    return c.table("orders").select("o_orderkey", canonical.canonical_hash(fields).alias("digest"))


@query("sequence_numbers", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS seq_no FROM orders")
def _(c: Context) -> DataFrame:
    return numbering.sequence_numbers(
        c.table("orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"],
        [F.col("o_orderdate"), F.col("o_orderkey")], [F.date_trunc("month", "o_orderdate"), F.col("o_orderdate"), F.floor(F.col("o_orderkey") / 1000)]).select("o_orderkey", "seq_no")


def _memberships(c: Context) -> DataFrame:
    """Customers as users: members of their nation, every third also of the next one."""
    users = c.table("customer").select("c_custkey", "c_nationkey")
    orgs = F.when(F.col("c_custkey") % 3 == 0, F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).otherwise(F.array("c_nationkey"))
    return users.select(F.col("c_custkey").alias("user_id"), F.explode(orgs).alias("org_id"))


_MEMBERS = "m AS (SELECT c_custkey AS user_id, c_nationkey AS org_id FROM customer UNION SELECT c_custkey, (c_nationkey + 1) % 25 FROM customer WHERE c_custkey % 3 = 0), r AS (SELECT o_orderkey, c_nationkey AS org_id FROM orders JOIN customer ON c_custkey = o_custkey)"


@query("tenant_visible", f"WITH {_MEMBERS} SELECT m.user_id, count(*) AS visible_rows FROM m JOIN r ON r.org_id = m.org_id GROUP BY m.user_id")
def _(c: Context) -> DataFrame:
    orders = c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("org_id"))
    return access.visible_counts(orders, _memberships(c))


@query("tenant_rows", f"WITH {_MEMBERS} SELECT o_orderkey, org_id FROM r WHERE org_id IN (SELECT org_id FROM m WHERE user_id = 3)")
def _(c: Context) -> DataFrame:
    orders = c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("org_id"))
    return access.visible_rows(orders, _memberships(c), 3)


@query("colleagues", f"WITH {_MEMBERS} SELECT DISTINCT user_id FROM m WHERE org_id IN (SELECT org_id FROM m WHERE user_id = 3)")
def _(c: Context) -> DataFrame:
    return access.colleagues(_memberships(c), 3)


@query("state_counts", """SELECT v.state, coalesce(n, 0) AS n FROM (VALUES ('queued'), ('running'), ('done'), ('failed'), ('dead')) v(state)
  LEFT JOIN (SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS state, count(*) AS n FROM orders GROUP BY 1) c ON c.state = v.state""")
def _(c: Context) -> DataFrame:
    status = F.col("o_orderstatus")
    states = c.table("orders").select(F.when(status == "F", "done").when(status == "O", "queued").otherwise("running").alias("state"))
    return quality.state_counts(states, "state")


