import datetime
import hashlib
import ipaddress
import random
from collections import Counter
from email.utils import parsedate_to_datetime

from pyspark.sql import functions as F

from relaytrail.functions import canonical, dates, net, similarity, text
from relaytrail.operators import guard
from relaytrail.sources.messages import base64url_bytes, unwrap_page


def expected_ip(value):
    try:
        a = ipaddress.ip_address(value)
    except ValueError:
        return None, "unknown"
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    docs = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32")
    if a.is_loopback:
        kind = "loopback"
    elif a.is_link_local:
        kind = "link_local"
    elif any(a in n for n in map(ipaddress.ip_network, docs) if n.version == a.version):
        kind = "public"
    elif a.version == 4 and a in ipaddress.ip_network("100.64.0.0/10"):
        kind = "cgnat"
    elif a.is_private:
        kind = "private"
    elif a.is_reserved or a.is_multicast or a.is_unspecified:
        kind = "reserved"
    else:
        kind = "public"
    return str(a), kind


def test_addresses_match_the_standard_library(spark):
    rng = random.Random(7)
    values = ["::ffff:203.0.113.9", "1::2::3", "01.2.3.4", ":1::2", "1:2:3:4:5:6:7::", "::", "a:b", "256.1.1.1"]
    for _ in range(150):
        values.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        groups = [rng.choice(("0", "0", "1", f"{rng.getrandbits(16):04x}")) for _ in range(8)]
        values.append(":".join(groups))
        values.append(str(ipaddress.IPv6Address(rng.getrandbits(128) & ((1 << rng.choice((32, 64, 128))) - 1))))
    df = spark.createDataFrame([(v,) for v in values], "ip string")
    for r in df.select("ip", net.ip_canonical(F.col("ip")).alias("c"), net.ip_class(F.col("ip")).alias("k")).collect():
        assert (r.c, r.k) == expected_ip(r.ip), r.ip


def test_mail_dates(spark):
    good = ["Tue, 2 Sep 2026 09:41:06 +0530", "Sun, 07 Sep 2026 03:14:22 -0700 (PDT)", "2 Sep 26 09:41 GMT", "1 Jan 2020 10:00:00 EST"]
    bad = ["32 Foo 2026 99:99:99 +9999", "not-a-date", "", "32 Sep 2026 10:00:00 +0000"]
    df = spark.createDataFrame([(v,) for v in good + bad + ["Mon, 01 Sep 2026 11:02:10 -0000"]], "d string")
    got = {r.d: r.t for r in df.select("d", dates.parse_mail_date(F.col("d")).alias("t")).collect()}
    for value in good:
        assert got[value] == parsedate_to_datetime(value).astimezone(datetime.UTC).replace(tzinfo=None)
    assert all(got[v] is None for v in bad)
    assert got["Mon, 01 Sep 2026 11:02:10 -0000"] == datetime.datetime(2026, 9, 1, 11, 2, 10)


def simhash(tokens):
    votes = [0] * 64
    for token, n in Counter(tokens).items():
        digest = int(hashlib.md5(token.encode()).hexdigest(), 16)
        for bit in range(64):
            votes[bit] += n if (digest >> bit) & 1 else -n
    return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_simhash_counts_every_token(spark):
    lists = [["a", "b", "a"], [], ["x"] * 600 + ["y", "z"] * 130, [f"t{i % 97}" for i in range(1000)]]
    df = spark.createDataFrame([(t,) for t in lists], "t array<string>")
    got = df.select("t", similarity.hex16(similarity.simhash64(F.col("t"))).alias("h")).collect()
    assert all(r.h == (simhash(r.t) if r.t else "0" * 16) for r in got)


def test_distances_and_folds(spark):
    df = spark.createDataFrame([("harbour", "habrour", 1), ("ca", "abc", 3), ("kitten", "sitting", 3), ("", "abc", 3)], "a string, b string, d int")
    for r in df.select("d", similarity.osa_distance(F.col("a"), F.col("b")).alias("got"), similarity.within_osa(F.col("a"), F.col("b"), 3).alias("near")).collect():
        assert r.got == r.d and r.near
    row = spark.range(1).select(
        similarity.saturating_fold(F.array(*[F.lit(x) for x in (0.55, 0.8, 0.55, 0.55, 0.55)])).alias("fold"),
        text.token_shape(F.lit("b1_9f2a1c88213")).alias("shape"),
        text.message_id_template(F.lit("<20260902T0408.9f2a1c@vps>")).alias("template"),
        net.registrable_domain(F.lit("news.bbc.co.uk"), F.array(F.lit("co.uk"), F.lit("uk"))).alias("domain"),
        text.confusable_skeleton(F.lit("nоrtｈb0nk"), normalise=True).alias("skeleton"),
    ).first()
    assert tuple(row) == (0.9447, "w2_w11", "NTN.H", "bbc.co.uk", "northbonk")


def test_canonical_json_ignores_order_and_formats_numbers(spark):
    a = {"b": F.lit(1), "a": canonical.decimal_text(F.lit(0.1)), "n": F.lit(None).cast("string")}
    b = dict(reversed(list(a.items())))
    row = spark.range(1).select(canonical.canonical_json(a).alias("a"), canonical.canonical_json(b).alias("b")).first()
    assert row.a == row.b == '{"a":"0.100000","b":1,"n":null}'


def test_payload_decoding_and_unwrapping(spark):
    df = spark.createDataFrame([("YWJj\r\nZA",), ("_-8",), ("A",)], "s string")
    assert [r[0] and bytes(r[0]) for r in df.select(base64url_bytes(F.col("s"))).collect()] == [b"abcd", b"\xff\xef", None]
    once = base64url_bytes(F.col("s"))  # the text is cleaned once, however often the expression uses it
    assert df.select(once)._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 1
    wrapped = spark.createDataFrame([("YW-_\r\nYQ==\u00e9",), ("",)], "s string").select(once).collect()
    assert [bytes(r[0]) for r in wrapped] == [b"ao\xbfa", b""]
    pages = [
        ("From: a@b.test\n\nhi", "From: a@b.test\n\nhi"),
        ("<html><pre>no</pre><pre>Received: x\nFrom: &lt;a&amp;lt;@b&gt;</pre></html>", "Received: x\nFrom: <a&lt;@b>"),
        ("<!DOCTYPE html><p>From: nobody</p>", None),
    ]
    got = spark.createDataFrame(pages, "page string, want string").select("want", unwrap_page(F.col("page")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_guards(spark):
    row = spark.range(1).select(
        guard.check_claims(F.lit("All fine. The attacker is in Rome. Bye")).alias("claims"),
        guard.redact_unknown_facts(F.lit("seen 10.1.1.1 and 8.8.8.8 at evil.test"), F.array(F.lit("8.8.8.8"))).alias("facts"),
        guard.quote_grounded(F.lit("Pay  NOW\nplease"), F.lit("pay now")).alias("grounded"),
        guard.quote_grounded(F.lit("Pay"), F.lit("")).alias("empty"),
    ).first()
    assert row.claims.text.startswith("All fine. Bye [A statement") and row.claims.violations == ["the attacker is in"]
    assert "8.8.8.8" in row.facts.text and "10.1.1.1" not in row.facts.text and "evil.test" not in row.facts.text
    assert row.grounded and not row.empty


def test_sketches_of_neighbours_are_made_once(spark):
    from __spark_entry__ import queries

    tokens = text.content_tokens(F.col("t"))
    sketch = spark.createDataFrame([("a",)], "t string").select(similarity.simhash64(tokens).alias("h"))
    assert sketch._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
    plan = queries()["hamming_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "regexp" not in plan
