import email.utils
import itertools

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relaytrail import fixed_values as fv
from relaytrail.functions.core import is_blank, spread_nulls, strip
from relaytrail.operators import attribution, narrative, parse, verify
from relaytrail.operators.durable import durable_table
from relaytrail.operators.fingerprint import fingerprint
from relaytrail.operators.indicators import message_indicators
from relaytrail.operators.linkage import similarity_of, with_form_id
from relaytrail.operators.views import case_details
from relaytrail.plans.analyse import analyse_messages, with_org_config
from relaytrail.config import AnalysisConfig
from relaytrail.sources import tables
from relaytrail.sources.messages import accepted, acquire
from tests.shapes import raw_frame


@pytest.fixture(scope="module")
def analysed(spark):
    return durable_table(analyse_messages(accepted(acquire(raw_frame(spark)))), "test_analysed")


@pytest.fixture(scope="module")
def cases(analysed):
    return {r.filename: r for r in analysed.collect()}


def rule_ids(case):
    return {f.rule_id for f in case.findings}


def expected_score(case):
    """The score from the findings alone: fold, weights and dampener, written out again."""
    groups = {}
    for f in case.findings:
        groups.setdefault(f.signal_group, []).append(fv.SEVERITY_WEIGHTS[f.severity])
    total = 0.0
    for group, weights in groups.items():
        fold = 0.0
        for w in sorted(weights, reverse=True):
            fold = w if fold == 0 else fold + w * (1 - fold) / 2
        total += round(round(min(1.0, fold), 4) * fv.GROUP_WEIGHTS[group], 2)
    base = total / sum(fv.GROUP_WEIGHTS[g] for g in fv.OFFLINE_GROUPS) * 100
    rules = rule_ids(case)
    if "AUTH_DMARC_ALIGNED_ESTABLISHED" in rules and not rules & {"IDENT_LOOKALIKE_DOMAIN", "IDENT_PROTECTED_DISPLAY_NAME", "IDENT_INVISIBLE_CHARS", "URL_LOOKALIKE_HOST"}:
        base += fv.LEGITIMACY_DAMPENER
    return max(0, min(100, round(base)))


def test_fraud_is_explained(cases):
    case = cases["fraud"]
    # two vouching hops, then the kit's own: 50 base + 20 boundary + 10 handoffs - 10 clock - 5 injected
    assert (case.boundary_seq, case.feos_ip, case.origin_confidence) == (1, "192.0.2.61", 65)
    assert case.origin_flags == ["timestamp_not_monotonic", "forged_authentication_results"]
    assert case.hops[1].anomalies == ["timestamp_not_monotonic"] and not case.hops[0].anomalies
    assert {
        "AUTH_INJECTED_RESULTS", "IDENT_LOOKALIKE_DOMAIN", "IDENT_PROTECTED_DISPLAY_NAME", "IDENT_REPLY_TO_DIVERGENT",
        "INFRA_FORGED_RECEIVED", "URL_CREDENTIAL_LANDING", "URL_LOOKALIKE_HOST", "CONTENT_URGENCY", "CONTENT_AUTHORITY",
        "CONTENT_SECRECY", "CONTENT_FINANCIAL", "CONTENT_CREDENTIAL", "ATTACH_PRESENT",
    } <= rule_ids(case)
    assert case.classification == "bec" and case.band in ("high", "critical")
    assert all(f.plain_summary for f in case.findings)


def test_scores_follow_from_the_findings(cases):
    for name in ("fraud", "wave_a", "wave_b", "newsletter", "reset"):
        assert cases[name].score == expected_score(cases[name]), name


def test_wanted_mail_is_benign(cases):
    assert (cases["newsletter"].score, cases["newsletter"].band) == (0, "benign")
    # the composer has no address and list7 is a provider, so the boundary hop's peer stands
    assert cases["newsletter"].boundary_seq == 1 and cases["newsletter"].feos_ip is None
    assert cases["reset"].band == "benign" and cases["reset"].feos_ip == "185.33.4.9"
    assert cases["reset"].html_present and "Choose a new password" in cases["reset"].text_body


def test_waves_are_not_benign_but_below_fraud(cases):
    for wave in ("wave_a", "wave_b"):
        assert cases[wave].origin_confidence == 90
        assert cases[wave].band == "suspicious" and cases[wave].classification == "credential_phishing"
        assert cases[wave].score < cases["fraud"].score


def test_nothing_of_a_large_message_is_cut(spark):
    links = "\n".join(f"https://site{i}.test/page/{i}" for i in range(299)) + "\nhttps://last.test/login/here"
    part = "--b\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=f%d.pdf\n\nx%d\n"
    head = "From: a@plain.test\nX-Long: " + "v" * 9000 + "\nContent-Type: multipart/mixed; boundary=b\n\n"
    body = "--b\nContent-Type: text/plain\n\n" + "filler " * 290_000 + "\n" + links + "\n"
    deep_open = "".join(f"--n{i}\nContent-Type: multipart/mixed; boundary=n{i + 1}\n\n" for i in range(24))
    deep = "From: a@plain.test\nContent-Type: multipart/mixed; boundary=n0\n\n" + deep_open + "--n24\nContent-Type: text/plain\n\nhttps://deep.test/login/x\n"
    mail = {"wide": (head + body + "".join(part % (i, i) for i in range(250)) + "--b--\n").encode(), "deep": deep.encode()}
    got = {r.filename: r for r in analyse_messages(accepted(acquire(raw_frame(spark, mail)))).collect()}
    wide = got["wide"]
    assert len(wide.urls) == 300 and len(wide.attachments) == 250 and len(wide.text_body) > 2_000_000
    assert any(f.rule_id == "URL_CREDENTIAL_LANDING" and "last.test" in f.evidence_ref for f in wide.findings)
    assert max(len(h.value) for h in wide.headers) == 9000
    assert any(f.rule_id == "URL_CREDENTIAL_LANDING" and "deep.test" in f.evidence_ref for f in got["deep"].findings)


def test_broken_mail_never_raises(cases):
    case = cases["broken"]
    assert case.defects and case.parse_status == "malformed"
    assert "IDENT_DUPLICATE_FROM" in rule_ids(case)
    assert 0 <= case.score <= 100 and case.sent_at is None


def test_no_received_headers_short_circuits(cases):
    case = cases["headless"]
    assert case.origin_confidence == 10
    assert [(t.term, t.value) for t in case.confidence_breakdown] == [("no_received_headers", -40)]
    assert case.feos_ip is None and "No Received headers" in case.claim_text


def test_second_trusted_header_counts_as_injected(cases):
    assert cases["fraud"].forged_pass_detected and cases["fraud"].discarded_headers == 1
    assert not cases["wave_a"].forged_pass_detected


def test_fingerprint_separates_toolkits(spark, analysed):
    dna = with_form_id(fingerprint(analysed, "org_id", "case_id", "filename"))
    form = F.struct("i", "d", "n", "m", "c", "p", "i_set", "d_set", "p_set")
    a = dna.select(F.col("filename").alias("x"), form.alias("fa"))
    b = dna.select(F.col("filename").alias("y"), form.alias("fb"))
    sims = {
        (r.x, r.y): r.s
        for r in a.crossJoin(b).where("x < y").select("x", "y", similarity_of(F.col("fa"), F.col("fb")).alias("s")).collect()
    }
    related = [sims[p].score for p in (("fraud", "wave_a"), ("fraud", "wave_b"), ("wave_a", "wave_b"))]
    unrelated = [s.score for (x, y), s in sims.items() if "newsletter" in (x, y) and {x, y} & {"fraud", "wave_a", "wave_b"}]
    assert min(related) - max(unrelated) > 0.20
    assert all(sims[p].sim_m >= 0.95 for p in (("fraud", "wave_a"), ("wave_a", "wave_b")))
    assert {len(r.barcode) for r in dna.collect()} == {48}


def test_org_config_overrides_defaults(spark):
    config = spark.createDataFrame(
        [("o", ["review.example"], ["Nobody"], ["other.test"])],
        "org_id string, protected_domains array<string>, protected_identities array<string>, trusted_authserv array<string>",
    )
    messages = accepted(acquire(raw_frame(spark)))
    row = with_org_config(messages, AnalysisConfig(), config).first()
    assert row.protected_domains == ["review.example"]


def test_attribution_prefers_the_longest_prefix(spark):
    raw = spark.createDataFrame(
        [("8.0.0.0/9", "3356", "Wide", "US", "isp", ""), ("8.8.8.0/24", "15169", "Narrow", "US", "dc", ""),
         ("203.0.113.0/24", "0", "Docs", "", "documentation", "x"), ("2001:db8::/32", "0", "Docs6", "", "documentation", ""),
         ("8.8.8.8/24", "1", "host bits", "", "", ""), ("oops", "1", "", "", "", "")],
        tables.PREFIX_SCHEMA,
    )
    prefixes = tables.prepare_prefixes(raw)
    assert prefixes.count() == 4
    ips = spark.createDataFrame([(i,) for i in ("8.8.8.8", "8.1.1.1", "10.0.0.14", "203.0.113.41", "1.2.3.4", "2001:db8::9", "x")], "ip string")
    got = {r.ip: r for r in attribution.attribute_addresses(ips, prefixes).collect()}
    assert (got["8.8.8.8"].asn, got["8.1.1.1"].asn) == (15169, 3356)
    assert got["10.0.0.14"].geo_source == "local"
    assert got["203.0.113.41"].net_type == "documentation" and got["203.0.113.41"].country is None
    assert got["1.2.3.4"].geo_source == "unavailable" and got["x"].geo_source == "unavailable"
    assert got["2001:db8::9"].asn_org == "Docs6"


def test_rows_without_a_peer_do_not_share_a_key(spark):
    hops = spark.createDataFrame([(i, "8.8.8.8" if i % 10 == 0 else None, "public" if i % 10 == 0 else "unknown") for i in range(500)], "k int, observed_ip string, ip_class string")
    prefixes = tables.prepare_prefixes(spark.createDataFrame([("8.8.8.0/24", "15169", "Narrow", "US", "dc", "")], tables.PREFIX_SCHEMA))
    got = attribution.enrich_hops(hops, prefixes).collect()
    assert len(got) == 500 and all(r.asn == (15169 if r.k % 10 == 0 else None) for r in got)
    keys = hops.select(spread_nulls(hops, F.col("observed_ip")).alias("x")).groupBy("x").count()
    assert keys.agg(F.max("count")).first()[0] == 50 and keys.count() > 300


def test_expired_dkim_key_is_indeterminate(spark):
    snapshot = spark.createDataFrame([("s1._domainkey.a.test", ["v=DKIM1; p=x"], True)], "name string, records array<string>, resolved boolean")
    mail = {
        "known": b"DKIM-Signature: v=1; d=a.test; s=s1; h=from:to; b=x=\nFrom: x@a.test\n\nhi",
        "weak": b"DKIM-Signature: v=1; d=a.test; s=s1; h=to; l=5; b=x=\nFrom: x@a.test\n\nhi",
        "expired": b"DKIM-Signature: v=1; d=b.test; s=s1; h=from; b=x=\nFrom: x@a.test\n\nhi",
    }
    parsed = analyse_messages(accepted(acquire(raw_frame(spark, mail)))).withColumn("verified", F.lit(True))
    got = {r.filename: r for r in verify.recheck_dkim(parsed, snapshot, "filename", verdict="verified").collect()}
    assert got["known"].result_recomputed == "pass" and got["known"].caveat is None
    assert "NOT covered" in got["weak"].caveat and "l= body-length" in got["weak"].caveat
    assert got["expired"].result_recomputed == "indeterminate" and got["expired"].aligned is False


def test_narrative_is_gated_by_score(analysed):
    got = {r.filename: r for r in narrative.templated_narrative(analysed, "filename").collect()}
    assert got["newsletter"].recommended_actions == ["No action required."]
    assert got["fraud"].unavailable_reason is None and "bec" in got["fraud"].explanation
    assert "below the generation threshold" in got["wave_a"].unavailable_reason


def test_plain_values_are_what_the_library_makes_of_them():
    words = ("a", "B-c", "x.y", "@", "<", ">", '"', " ", ",", ";", "=?utf-8?q?a?=", "\u00e9", "<a@b.c>", '"A b" ', "A b ", "(c)", "..", "[1.2.3.4]", "text/plain", '; charset="utf-8"', "; x=y")
    values = {"".join(v) for n in (1, 2, 3) for v in itertools.product(words, repeat=n)}
    taken = 0
    for name in ("From", "Reply-To", "Message-ID", "Content-Type"):
        for value in values:
            plain = parse._plain_value(name.lower(), value.strip())
            if plain is not None:
                taken += 1
                assert plain == str(parse._HEADER_FACTORY(name, value.strip())), (name, value)
    assert taken > 100
    for value in values:
        mailbox = parse._plain_mailbox(value.strip())
        assert mailbox is None or [mailbox] == email.utils.getaddresses([value.strip()]), value


def test_plain_headers_are_not_parsed_by_grammar():
    raw = b'From: "Desk A" <a@b.test>\nReply-To: c@d.test\nMessage-ID: <1.x@b.test>\nContent-Type: multipart/mixed; boundary="once_7"\n\n--once_7--\n'
    before = parse._structured.cache_info().misses
    got = parse._decode_one(raw)
    assert parse._structured.cache_info().misses == before
    assert [h["value"] for h in got["headers"]][:2] == ["Desk A <a@b.test>", "c@d.test"]
    assert [(a["header"], a["display"], a["address"]) for a in got["addresses"]] == [("from", "Desk A", "a@b.test"), ("reply-to", "", "c@d.test")]


def test_messages_of_a_batch_are_decoded_in_pieces():
    large = b"Subject: s\n\n" + b"x" * parse.PIECE_BYTES
    content = pa.array([large, b"Subject: t\n\ny", None, large, large], pa.binary())
    assert [len(p) for p in parse._decoded_pieces(content)] == [1, 3, 1, 0]
    got = parse._decode_batch(content).to_pylist()
    assert [r and r["headers"][0]["value"] for r in got] == ["s", "t", None, "s", "s"]
    assert len(parse._decode_batch(pa.array([], pa.binary()))) == 0


def test_blank_text_is_known_at_the_first_character(spark):
    df = spark.createDataFrame([(t,) for t in ("", " \u00a0\u2003\n\t", "\x1c", " a", "\n\u200b", None)], "t string")
    got = df.select(is_blank(F.col("t")).alias("b"), (strip(F.col("t")) == "").alias("s")).collect()
    assert [r.b for r in got] == [r.s for r in got] == [True, True, True, False, False, None]


def test_values_of_indicators_are_trimmed_once(analysed):
    assert message_indicators(analysed, "case_id")._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1
    assert case_details(analysed, "org_id").columns[:2] == ["org_id", "case_id"]


def test_case_details_need_no_join(spark):
    from __spark_entry__ import queries

    plan = queries()["case_details"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
