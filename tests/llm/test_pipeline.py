"""The pipeline end to end against its stages done by hand."""

import collections

import corpus_pipeline
from relaytrail.llm import mixing, quality


def test_stages_hand_on_whole_rows_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, [r.doc_id for r in docs.select("doc_id").collect()]
    kept = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf).cache()
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(set(after)) == len(after) and set(after) <= set(ids)
        if n < 4:
            assert docs.columns == columns
        if name == "quality_rules":
            assert set(after) == kept
        if name == "exact_dedup":
            squeezed = collections.Counter("".join(r.text.split()) for r in before.collect())
            assert len(after) == len(squeezed)
        if name == "mixing":
            rated = mixing.mixing_rates(before, spark.read.parquet(f"{sf}/labels.parquet"), targets=corpus_pipeline.TARGETS, most=1.0)
            assert set(after) == {r.doc_id for r in rated.filter("copies > 0").collect()}
        if name == "byte_bpe":
            assert set(after) == set(ids)
        ids = after


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns[:2] == ["doc_id", "n_tokens"] and 0 < got.count() <= 200
