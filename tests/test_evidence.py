import datetime
import hashlib

from pyspark.sql import functions as F

from relaytrail.operators import evidence


def events(spark, sizes):
    start = datetime.datetime(2026, 9, 1)
    rows = [("o", f"c{n}", start + datetime.timedelta(seconds=i), "tester", "parsed", hashlib.sha256(f"{n}{i}".encode()).hexdigest(), i) for n in sizes for i in range(n)]
    return spark.createDataFrame(rows, "org_id string, case_id string, ts_utc timestamp, actor string, action string, payload_hash string, ord int")


def root(leaves):
    level = list(leaves)
    while len(level) > 1:
        pairs = [hashlib.sha256(bytes.fromhex(level[i] + level[i + 1])).hexdigest() for i in range(0, len(level) - 1, 2)]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def test_chain_verifies_and_names_the_broken_event(spark):
    chain = evidence.build_chain(events(spark, [1, 5, 6])).persist()
    assert evidence.verify_events(chain).where("NOT (hash_ok AND link_ok)").count() == 0
    altered = chain.withColumn("actor", F.when((F.col("case_id") == "c5") & (F.col("seq") == 2), "x").otherwise(F.col("actor")))
    deleted = altered.where("NOT (case_id = 'c6' AND seq = 3)")
    cases = spark.createDataFrame([("c1",), ("c5",), ("c6",), ("none",)], "case_id string")
    got = {r.case_id: r for r in evidence.chain_summary(cases, evidence.verify_events(deleted)).collect()}
    assert got["c1"].intact and got["c1"].first_broken_seq is None
    assert not got["c5"].intact and got["c5"].first_broken_seq == 2
    assert not got["c6"].intact and got["c6"].first_broken_seq == 4
    assert not got["none"].intact and got["none"].event_count == 0


def test_chain_continues_after_a_stored_tail(spark):
    whole = {(r.case_id, r.seq): r.entry_hash for r in evidence.build_chain(events(spark, [6])).collect()}
    first = evidence.build_chain(events(spark, [6]).where("ord < 4")).persist()
    rest = evidence.build_chain(events(spark, [6]).where("ord >= 4"), tails=evidence.chain_tails(first))
    joined = {(r.case_id, r.seq): r.entry_hash for r in first.unionByName(rest).collect()}
    assert joined == whole


def test_merkle_roots_and_proofs_across_blocks(spark):
    sizes = [1, 2, 3, 5, 1024, 1025, 2500]
    rows = [(f"k{n}", i, hashlib.sha256(f"{n}-{i}".encode()).hexdigest()) for n in sizes for i in range(n)]
    leaves = spark.createDataFrame(rows, "case_id string, pos long, hash string")
    roots = evidence.merkle_roots(leaves)
    for r in roots.collect():
        n = int(r.case_id[1:])
        assert r.merkle_root == root([hashlib.sha256(f"{n}-{i}".encode()).hexdigest() for i in range(n)])
    checked = evidence.verify_proofs(leaves, evidence.merkle_proofs(leaves), roots)
    assert checked.count() == sum(sizes) and checked.where("NOT proof_ok").count() == 0
