import datetime
import tempfile

import pytest
from pyspark.sql import functions as F

from relaytrail.operators.evidence import build_chain, stage_chain, stage_events, verify_events
from relaytrail.operators.numbering import next_case_refs
from relaytrail.plans.analyse import analyse_messages
from relaytrail.plans.ingest import ingest_batch, new_messages, winners
from relaytrail.plans.store import CaseStore
from relaytrail.sources.messages import RAW_SCHEMA, accepted, acquire, read_eml_files
from relaytrail.streaming.pipeline import HELD_EVENTS, analyse_stream, campaign_activity, chain_stream, ingest_stream
from tests.shapes import SHAPES, raw_frame


BATCH_COPIES = {f"{name}-again": content.replace(b"Message-ID: <", b"Message-ID: <x") + b"\n" for name, content in SHAPES.items()}


def numbers(store, name, *columns):
    return sorted(map(str, store.read(name).select(*columns).collect()))


def campaigns_of(store):
    groups = {}
    for r in store.latest("campaign_members", "case_id").collect():
        groups.setdefault(r.campaign_id, set()).add(r.case_id)
    return groups


def test_ingest_in_batches_equals_one_run(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw, more = raw_frame(spark), raw_frame(spark, BATCH_COPIES)
    once = CaseStore(spark, f"{folder}/once")
    ingest_batch(raw.unionByName(raw).unionByName(more), once.root, batch="all")
    parts = CaseStore(spark, f"{folder}/parts")
    ingest_batch(raw.unionByName(raw), parts.root, batch="first")
    # a batch that is cut off before its commit is no part of the tables, and leaves none of itself when repeated
    for name in ("cases", "links", "components", "campaign_members"):
        parts.write(name, parts.read(name).drop("batch_id"), "second")
    parts.add_known(acquire(more).select("case_id"), "second")
    assert parts.read("cases").count() == len(SHAPES)
    ingest_batch(raw.unionByName(more), parts.root, batch="second")
    ingest_batch(raw.unionByName(more), parts.root, batch="second")
    assert parts.read("cases").count() == len(SHAPES) + len(BATCH_COPIES)
    assert numbers(parts, "cases", "case_id", "score", "band") == numbers(once, "cases", "case_id", "score", "band")
    assert parts.read("cases").select("case_ref").distinct().count() == len(SHAPES) + len(BATCH_COPIES)
    assert numbers(parts, "links", "a_fp", "b_fp", "score") == numbers(once, "links", "a_fp", "b_fp", "score")
    assert campaigns_of(parts) == campaigns_of(once) and campaigns_of(once)
    sizes = {r.campaign_id: r.member_count for r in parts.latest("campaigns", "campaign_id").collect()}
    assert {k: v for k, v in sizes.items() if k in campaigns_of(once)} == {k: len(v) for k, v in campaigns_of(once).items()}
    for store in (once, parts):
        chain = store.read("evidence_events")
        assert verify_events(chain.drop("batch_id")).where("NOT (hash_ok AND link_ok)").count() == 0
        assert {r.action for r in chain.select("action").distinct().collect()} == {
            "acquired", "parsed", "auth_evaluated", "origin_reconstructed", "scored", "campaign_linked",
        }
        assert store.read("reports").count() == store.read("cases").count()


def test_known_cases_are_joined_where_they_lie(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw = raw_frame(spark)
    store = CaseStore(spark, folder, buckets=4)
    store.add_known(acquire(raw).select("case_id").limit(2), "a")
    store.commit("a", 1)
    keys = acquire(raw).select("case_id", "acquired_at", "filename")
    plan = new_messages(keys, store.known().hint("shuffle_hash"))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "known_cases" in line or "Exchange hashpartitioning(case_id" in line]
    assert sum("Exchange hashpartitioning" in x for x in scans) == 1 and any("Bucketed: true" in x for x in scans), plan
    assert winners(raw, store.known()).count() == len(SHAPES) - 2


def test_case_numbers_keep_gaps(spark):
    existing = spark.createDataFrame([("o", "CASE-2026-0001"), ("o", "CASE-2026-0003"), ("o", "CASE-2025-0009")], "org_id string, case_ref string")
    new = acquire(raw_frame(spark, {"a": b"From: a@b\n\n1"}))
    assert next_case_refs(new, existing).first().case_ref == "CASE-2026-0004"


def test_message_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name, content in SHAPES.items():
        with open(f"{folder}/{name}.eml", "wb") as handle:
            handle.write(content)
    raw = read_eml_files(spark, folder, "o")
    assert raw.count() == len(SHAPES)
    stream_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    stream = read_eml_files(spark, folder, "o", stream=True)
    query = ingest_stream(stream, f"{stream_root}/tables", f"{stream_root}/checkpoint")
    query.awaitTermination(180)
    query.stop()
    assert spark.read.parquet(f"{stream_root}/tables/cases").count() == len(SHAPES)


def test_stream_gives_the_batch_result(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raw = raw_frame(spark)
    raw.unionByName(raw).write.parquet(f"{folder}/raw")
    source = spark.readStream.schema(RAW_SCHEMA).parquet(f"{folder}/raw")
    scored = analyse_stream(source).select("case_id", "score", "band", "classification")
    query = (
        scored.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    query.stop()
    streamed = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
    batch = analyse_messages(accepted(acquire(raw))).select("case_id", "score", "band", "classification")
    assert streamed == sorted(map(tuple, batch.collect()))


def test_stages_link_in_the_row_as_in_a_chain(spark):
    analysed = analyse_messages(accepted(acquire(raw_frame(spark))))
    columns = ("org_id", "case_id", "ts_utc", "actor", "action", "payload_hash", "seq", "prev_hash", "entry_hash")
    linked = stage_chain(analysed)
    assert "MapInArrow" not in linked._jdf.queryExecution().toString()
    got = sorted(map(str, linked.select(*columns).collect()))
    assert got == sorted(map(str, build_chain(stage_events(analysed)).select(*columns).collect()))


def run_stream(frame, folder):
    query = (
        frame.writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    query.stop()


@pytest.mark.parametrize("held", [HELD_EVENTS, 3])
def test_streamed_chain_equals_the_batch_chain(spark, held):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = stage_events(analyse_messages(accepted(acquire(raw_frame(spark, dict(list(SHAPES.items())[:3]))))))
    later = events.withColumns({"ord": F.col("ord") + 10, "action": F.concat("action", F.lit("_again"))})
    for part in (events, later):  # two runs: the second continues what the first has left
        part.orderBy(F.rand(1)).repartition(3).write.mode("append").parquet(f"{folder}/events")
        run_stream(chain_stream(spark.readStream.schema(events.schema).parquet(f"{folder}/events"), held), folder)
    columns = ("case_id", "seq", "action", "prev_hash", "entry_hash")
    got = sorted(map(str, spark.read.parquet(f"{folder}/out").select(*columns).collect()))
    assert got == sorted(map(str, build_chain(events.unionByName(later)).select(*columns).collect()))


def test_streamed_sessions_equal_the_batch_sessions(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "org_id string, campaign_id string, score int, created_at timestamp"
    at = lambda hour: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=hour)
    rows = [("o", c, h, at(h)) for c, hours in {"a": (0, 1, 5, 30), "b": (3, 50, 52)}.items() for h in hours]

    def arrive(batch):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_stream(campaign_activity(spark.readStream.schema(schema).parquet(f"{folder}/in"), watermark="1 hour"), folder)

    arrive(rows)
    late = [("o", "a", 99, at(2)), ("z", "end", 0, at(500))]  # long after its session was closed
    arrive(late)
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {tuple(r) for r in campaign_activity(spark.createDataFrame(rows, schema)).collect()}


def test_tasks_of_the_analysis_grow_with_the_messages(spark):
    from workload.context import Context
    from workload.mail_view import MESSAGES_A_TASK, spread

    c = Context(spark, "/root/testdata/sf0.001")
    files = len(c.raw.inputFiles())
    assert files >= 16 and min(len(c.analysed.inputFiles()), len(c.dna.inputFiles())) > files // 2  # a task writes a file
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    assert spread(c.raw, 300 * MESSAGES_A_TASK).rdd.getNumPartitions() == 300
