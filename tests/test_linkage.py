import random

import pytest
from pyspark.sql import functions as F

from relaytrail.functions.similarity import lcs_length
from relaytrail.operators import campaign, graph, indicators, linkage
from relaytrail.operators.durable import durable_table

SCHEMA = (
    "org_id string, case_id string, dna_version string, i struct<x:array<string>>, d struct<x:array<string>>, "
    "n struct<tld:string,features:array<double>,trigrams:array<string>>, "
    "m struct<header_order:array<string>,header_order_hash:string,x_mailer:string,boundary_shape:string,message_id_template:string>, "
    "c struct<simhash:bigint,token_count:int,template_markers:array<string>>, p struct<x:array<string>>, "
    "i_set array<string>, d_set array<string>, p_set array<string>"
)


def some(rng, letters, n):
    return sorted(rng.sample(letters, rng.randint(0, n)))


def random_dna(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for case in range(n):
        if rows and rng.random() < 0.3:  # copies
            rows.append((rows[0][0], f"c{case:04d}", *rows[rng.randrange(len(rows))][2:]))
            continue
        order = rng.sample(["from", "to", "subject", "date", "x-mailer"], rng.randint(3, 5))
        i, d, p = some(rng, ["a", "b", "c", "d"], 3), some(rng, ["q", "r", "s"], 3), some(rng, ["u", "v", "w", "x"], 3)
        rows.append((
            "o1", f"c{case:04d}", "v1", (i,), (d,),
            (rng.choice(["com", "test"]), [float(rng.randint(3, 9)), 1.0, 0.0, 2.0, 2.0], some(rng, ["abc", "bcd", "cde"], 3)),
            (order, "|".join(order), rng.choice([None, "kit", "tool"]), rng.choice([None, "w2", "w3"]), rng.choice([None, "N.H", "H"])),
            (rng.getrandbits(63), 5, some(rng, ["X", "Y"], 2)), (p,), i, d, p,
        ))
    return rows


def all_links(spark, dna):
    form = F.struct("i", "d", "n", "m", "c", "p", "i_set", "d_set", "p_set")
    a = dna.select(F.col("case_id").alias("a"), form.alias("fa"))
    b = dna.select(F.col("case_id").alias("b"), form.alias("fb"))
    pairs = a.crossJoin(b).where("a <> b").select("a", "b", F.inline(linkage.link_of(F.col("fa"), F.col("fb"))))
    return {(r.a, r.b): r.score for r in pairs.collect()}


@pytest.mark.parametrize("seed,chunk,refine,mailer", [(1, 2000, 256, None), (3, 1, 0, None), (5, 30, 5, "kit")])
def test_blocking_finds_exactly_the_links_of_all_pairs(spark, seed, chunk, refine, mailer):
    dna = spark.createDataFrame(random_dna(seed, 90), SCHEMA)
    if mailer:
        dna = dna.withColumn("m", F.col("m").withField("x_mailer", F.lit(mailer)))
    forms = linkage.distinct_forms(dna).persist()
    links = linkage.form_links(forms, chunk_rows=chunk, refine_rows=refine).unionByName(linkage.copy_links(forms))
    got = {(r.case_id, r.other_case): r.score for r in linkage.case_links(dna, links).collect()}
    want = all_links(spark, dna)
    assert want and got == want
    top = {(r.case_id, r.link_rank): (r.other_case, r.score) for r in linkage.top_form_links(forms, links, dna, limit=3).collect()}
    ranked = {}
    for (case, other), score in sorted(want.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        ranked.setdefault(case, []).append((other, score))
    assert top == {(case, n + 1): x for case, others in ranked.items() for n, x in enumerate(others[:3])}
    forms.unpersist()


@pytest.mark.parametrize("chunk", [2000, 40])
def test_deciding_links_give_the_members_and_ranks_of_all_links(spark, monkeypatch, chunk):
    """Large blocks are scored by matrices: the same values, and far fewer links where only the deciding are asked for."""
    dna = spark.createDataFrame(random_dna(9, 260), SCHEMA).withColumn("m", F.col("m").withField("x_mailer", F.lit("kit")))
    forms = durable_table(linkage.distinct_forms(dna), "forms")
    copies = linkage.copy_links(forms)
    by_tiles = {tuple(r) for r in linkage.form_links(forms, chunk_rows=chunk).collect()}
    one, some = (durable_table(linkage.form_links(forms, chunk_rows=chunk, strongest=n).unionByName(copies), "deciding") for n in (1, 4))
    monkeypatch.setattr(linkage, "TILED_PAIRS", 1 << 60)
    every = durable_table(linkage.form_links(forms, chunk_rows=chunk), "links")
    assert by_tiles == {tuple(r) for r in every.collect()} and one.count() < every.count()
    every = every.unionByName(copies)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(campaign.campaign_members(dna, one, forms)) == rows(campaign.campaign_members(dna, every, forms))
    assert rows(linkage.top_form_links(forms, some, dna, limit=3)) == rows(linkage.top_form_links(forms, every, dna, limit=3))


def test_batches_find_the_links_of_one_run(spark):
    dna = spark.createDataFrame(random_dna(6, 90), SCHEMA)
    forms = durable_table(linkage.distinct_forms(dna), "forms")
    whole = {(r.a_fp, r.b_fp): r.score for r in linkage.form_links(forms).collect()}
    third = F.pmod(F.xxhash64("fp_id"), F.lit(3))
    stored = stored_keys = index = None
    got = {}
    for n in range(3):
        sketched = durable_table(linkage.sketches(forms.where(third == n)), "sketches")
        index = index or linkage.link_index(sketched, refine_rows=4)
        keys = durable_table(linkage.block_keys(sketched, index), "keys")
        found = linkage.new_links(sketched, keys, stored, stored_keys, chunk_rows=5).collect()
        assert not {(r.a_fp, r.b_fp) for r in found} & set(got)
        got |= {(r.a_fp, r.b_fp): r.score for r in found}
        stored = sketched if stored is None else stored.unionByName(sketched)
        stored_keys = keys if stored_keys is None else stored_keys.unionByName(keys)
    assert whole and got == whole


def test_common_order_is_the_longest_common_subsequence(spark):
    rng = random.Random(3)
    rows = [(rng.sample("abcdefghijklmnopqrstu", rng.randint(0, 21)), rng.sample("abcdefghijklmnopqrstu", rng.randint(0, 21))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert df.where(linkage.common_order(F.col("a"), F.col("b")) != lcs_length(F.col("a"), F.col("b"))).count() == 0


def test_components_and_members(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x1", "x3"), ("x3", "x2"), ("z", "z")]
    got = {r.node: r.component for r in campaign.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(61))
    assert got["x1"] == got["x2"] == got["x3"] == "x1" and got["z"] == "z"


def test_hub_values_do_not_link(spark):
    rows = [("o", "c1", "domain", "gmail.com"), ("o", "c2", "domain", "gmail.com"), ("o", "c1", "ip", "9.9.9.9"), ("o", "c2", "ip", "9.9.9.9"), ("o", "c3", "url", "9.9.9.9")]
    table = spark.createDataFrame(rows, "org_id string, case_id string, type string, normalised string").withColumn("value", F.col("normalised"))
    roots = table.where("case_id = 'c1'").select("org_id", "case_id").distinct()
    hop = {(r.normalised, r.other_case) for r in graph.second_hop(roots, table).collect()}
    assert hop == {("9.9.9.9", "c2")}
    loose = {(r.normalised, r.other_case) for r in graph.second_hop(roots, table, match_type=False).collect()}
    assert loose == {("9.9.9.9", "c2"), ("9.9.9.9", "c3")}
    edges = graph.graph_edges(table, spark.createDataFrame([], "org_id string, case_id string, campaign_id string, dna_score double")).where("edge_type = 'shares'")
    assert edges.count() == 2
    tenants = table.unionByName(table.where("case_id = 'c1'").withColumns({"org_id": F.lit("p"), "case_id": F.lit("d1"), "value": F.lit("9.9.9.9 seen by p")}))
    cases = spark.createDataFrame([("o", "c1", "C1", 5, "benign"), ("p", "d1", "D1", 7, "benign")], "org_id string, case_id string, case_ref string, score int, band string")
    none = spark.createDataFrame([], "org_id string, campaign_id string, name string, member_count long")
    nodes = {(r.org_id, r.node_id): r.label for r in graph.graph_nodes(cases, tenants, none).collect()}
    assert nodes["o", "ip:9.9.9.9"] == "9.9.9.9" and nodes["p", "ip:9.9.9.9"] == "9.9.9.9 seen by p"
    assert {r.org_id for r in graph.graph_edges(tenants, spark.createDataFrame([], "org_id string, case_id string, campaign_id string, dna_score double")).where("target = 'ip:9.9.9.9' AND edge_type = 'shares'").collect()} == {"o"}
    idf = {r.normalised: r.df for r in indicators.indicator_idf(table).collect()}
    assert idf == {"gmail.com": 2, "9.9.9.9": 3}


def test_pairs_of_a_case_graph_are_not_shuffled(spark, monkeypatch):
    """Roots times cases of a popular value: what comes out of the join is stored as it is."""
    plans, store = {}, graph.durable_table

    def watched(rows, name):
        plans[name] = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return store(rows, name)

    monkeypatch.setattr(graph, "durable_table", watched)
    rows = [("o", f"c{n}", "url", v, v) for n in range(6) for v in ("x", f"y{n % 2}")] + [("o", "c1", "ip", "x", "x"), ("o", "c2", "url", "x", "X")]
    seen = spark.createDataFrame(rows, "org_id string, case_id string, type string, normalised string, value string")
    cases = seen.selectExpr("org_id", "case_id", "case_id AS case_ref", "1 AS score", "'low' AS band").distinct()
    members = spark.createDataFrame([], "org_id string, campaign_id string, case_id string, dna_score double")
    campaigns = spark.createDataFrame([], "org_id string, campaign_id string, name string, member_count long")
    roots = cases.where("case_id IN ('c0', 'c1')").select("org_id", "case_id")
    _, edges = graph.case_graph(roots, cases, seen, members, campaigns)
    got = sorted((r.root_case, r.edge_type, r.source, r.target) for r in edges.collect())
    values = {(k, t, v) for _, k, t, v, _ in rows}
    want = sorted(
        [(r, "contains", f"case:{r}", f"{t}:{v}") for r in ("c0", "c1") for k, t, v in values if k == r]
        + [(r, "shares", f"case:{k}", f"{t}:{v}") for r in ("c0", "c1") for k, t, v in values if k != r and (r, t, v) in values]
    )
    assert got == want
    join = next(n for n, line in enumerate(plans["graph_cases"]) if "Join" in line)
    assert "Join Inner" in plans["graph_cases"][join] and not any("Aggregate" in line for line in plans["graph_cases"][:join])


def test_linked_cases_and_their_values_come_with_the_pair(spark):
    dna = spark.createDataFrame(random_dna(7, 70), SCHEMA)
    forms = linkage.distinct_forms(dna).persist()
    links = linkage.form_links(forms).unionByName(linkage.copy_links(forms)).persist()
    every = linkage.case_links(dna, links)
    rng = random.Random(7)
    rows = [("o1", f"c{n:04d}", v) for n in range(70) for v in rng.sample("abcdefghij", 3)] + [("o1", "c0003", "alone")]
    values = spark.createDataFrame(rows, "org_id string, case_id string, normalised string")
    idf = indicators.indicator_idf(values)
    shared = linkage.shared_indicators(every, values, idf)
    want = {
        (r.case_id, r.other_case): (r.score, r.shared_indicators or [])
        for r in every.join(shared, ["org_id", "case_id", "other_case"], "left").where("case_id < other_case").collect()
    }
    own = linkage.shareable_values(values, idf)
    members = linkage.with_form_id(dna).select("org_id", "fp_id", "case_id").join(own, ["org_id", "case_id"], "left")
    pairs = linkage.linked_cases(members, links).collect()
    got = {(r.a.case_id, r.b.case_id): (r.score, sorted(set(r.a.shareable or []) & set(r.b.shareable or []))) for r in pairs}
    assert len(pairs) == len(want) and got == want and any(v for _, v in got.values())


def test_blocks_that_matrices_score_whole_are_not_cut(spark):
    dna = spark.createDataFrame(random_dna(9, 700), SCHEMA).withColumn("m", F.col("m").withField("x_mailer", F.lit("kit")))
    sketched = durable_table(linkage.sketches(linkage.distinct_forms(dna)), "sketches")
    forms = sketched.count()
    assert forms > 300
    index = linkage.link_index(sketched)
    tooling = linkage.tooling_keys(sketched).select("org_id", "fid", "key")
    assert index.large.count() == 0 and tooling.join(linkage.block_keys(sketched, index), ["org_id", "fid", "key"], "left_anti").count() == 0
