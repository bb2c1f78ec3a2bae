"""What the step that finds the deciding links looks at, and that nothing is lost by it."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relaytrail.operators import campaign, link_tiles, linkage
from relaytrail.operators.durable import durable_table
from tests.test_linkage import SCHEMA, random_dna


def of_one_mailer(spark, seed, n):
    return spark.createDataFrame(random_dna(seed, n), SCHEMA).withColumn("m", F.col("m").withField("x_mailer", F.lit("kit")))


def test_only_pairs_that_can_decide_get_exact_values(spark, monkeypatch):
    tooling = {"x_mailer": "kit", "boundary_shape": "w2", "message_id_template": "N.H", "header_order_hash": "from|to"}
    same = F.col("m").withField("header_order", F.array(F.lit("from"), F.lit("to")))
    for name, value in tooling.items():
        same = same.withField(name, F.lit(value))
    forms = linkage.distinct_forms(spark.createDataFrame(random_dna(11, 800), SCHEMA).withColumn("m", same))
    sketched = durable_table(linkage.sketches(forms), "sketches")
    each, per_form, _ = linkage.block_sides(sketched, durable_table(linkage.block_keys(sketched, linkage.link_index(sketched)), "keys"))
    under = linkage._under_blocks(each, per_form, True)
    largest = under.groupBy("key").count().orderBy(F.desc("count")).first()
    rows = under.where(F.col("key") == largest["key"]).toArrow()
    n = rows.num_rows
    assert n > 300
    looked_at, links = [], link_tiles.Pairs.links

    def counted(self, r, c, common):
        looked_at.append(len(r))
        return links(self, r, c, common)

    monkeypatch.setattr(link_tiles.Pairs, "links", counted)
    key = (pa.scalar("o1"), pa.scalar("v1"), pa.scalar(0), pa.scalar(0), pa.scalar(0))
    every = link_tiles.group_links(key, rows, rows, None, True).num_rows
    whole = sum(looked_at)
    looked_at.clear()
    deciding = link_tiles.group_links(key, rows, rows, 1, True).num_rows
    assert every <= whole < n * n and deciding < every // 10 and sum(looked_at) < whole // 10


def test_blocks_of_the_same_forms_are_one(spark):
    sketched = durable_table(linkage.sketches(linkage.distinct_forms(of_one_mailer(spark, 12, 120))), "sketches")
    keys = durable_table(linkage.block_keys(sketched, linkage.link_index(sketched)), "keys")
    _, per_form, _ = linkage.block_sides(sketched, keys)
    blocks = {}
    for r in per_form.collect():
        for b in r.blocks:
            blocks.setdefault(b.key, set()).add(bytes(r.fid))
    given = {}
    for r in keys.collect():
        given.setdefault(r.key, set()).add(bytes(r.fid))
    shared = {frozenset(v) for v in given.values() if len(v) > 1}
    assert {frozenset(v) for v in blocks.values()} == shared and len(blocks) == len(shared)


@pytest.mark.parametrize("chunk", [2000, 25])
def test_floors_of_small_blocks_lose_no_deciding_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(linkage, "TILED_PAIRS", 2500)  # some blocks are small, others are not
    dna = spark.createDataFrame(random_dna(13, 300), SCHEMA)
    forms = durable_table(linkage.distinct_forms(dna), "forms")
    copies = linkage.copy_links(forms)
    every = durable_table(linkage.form_links(forms, chunk_rows=chunk).unionByName(copies), "every")
    one, some = (durable_table(linkage.form_links(forms, chunk_rows=chunk, strongest=n).unionByName(copies), "deciding") for n in (1, 4))
    assert one.count() < some.count() < every.count()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(campaign.campaign_members(dna, one, forms)) == rows(campaign.campaign_members(dna, every, forms))
    assert rows(linkage.top_form_links(forms, some, dna, limit=3)) == rows(linkage.top_form_links(forms, every, dna, limit=3))


def test_large_blocks_of_batches_have_the_links_of_one_run(spark, monkeypatch):
    monkeypatch.setattr(linkage, "TILED_PAIRS", 40)
    forms = durable_table(linkage.distinct_forms(of_one_mailer(spark, 14, 90)), "forms")
    whole = {(r.a_fp, r.b_fp): r.score for r in linkage.form_links(forms, chunk_rows=20).collect()}
    half = F.pmod(F.xxhash64("fp_id"), F.lit(2))
    first, second = (durable_table(linkage.sketches(forms.where(half == n)), "sketches") for n in range(2))
    index = linkage.link_index(first)
    keys = [durable_table(linkage.block_keys(s, index), "keys") for s in (first, second)]
    got = linkage.new_links(first, keys[0], chunk_rows=20).collect() + linkage.new_links(second, keys[1], first, keys[0], chunk_rows=20).collect()
    assert whole and len(got) == len(whole) and {(r.a_fp, r.b_fp): r.score for r in got} == whole
