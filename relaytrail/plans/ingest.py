"""Corpus ingest: deduplicate, number, analyse, link and write all case tables, a batch at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from relaytrail.config import AnalysisConfig
from relaytrail.operators import linkage
from relaytrail.operators.attribution import enrich_hops, enrich_origin
from relaytrail.operators.auth import auth_rows
from relaytrail.operators.campaign import campaign_rollup, merge_components, with_shared_indicators
from relaytrail.operators.durable import durable_table
from relaytrail.operators.evidence import build_chain, chain_tails, later_events, merkle_leaves, merkle_roots, stage_chain
from relaytrail.operators.fingerprint import fingerprint
from relaytrail.operators.hops import hop_rows
from relaytrail.operators.indicators import indicator_idf, message_indicators
from relaytrail.operators.numbering import next_campaign_names, next_case_refs
from relaytrail.operators.parse import header_rows
from relaytrail.operators.report import case_documents, register_reports
from relaytrail.operators.rules import finding_rows
from relaytrail.operators.verify import dmarc_policies, recheck_dkim
from relaytrail.plans.analyse import analyse_messages
from relaytrail.plans.store import CaseStore
from relaytrail.sources.messages import accepted, acquire

KEYS = ("org_id", "case_id", "ingest_date")
#: What attribution adds to the tables; null without prefixes, so that all batches have one schema.
_HOP_NETWORK = {"asn": "int", "asn_org": "string", "country": "string", "net_type": "string"}
_ORIGIN_NETWORK = {
    "feos_asn": "int", "feos_org": "string", "feos_country": "string", "net_type": "string", "geo_dataset": "string", "geo_available": "boolean",
}


def first_copies(acquired: DataFrame) -> DataFrame:
    """Earliest copy of every (organisation, digest).

    The rank limit is applied before the shuffle as well, so a message sent a million times
    moves once per task.
    """
    order = Window.partitionBy("case_id").orderBy("acquired_at", "filename")
    return acquired.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def new_messages(acquired: DataFrame, known: DataFrame | None) -> DataFrame:
    """Messages whose case does not exist yet; ``known`` has ``case_id``."""
    fresh = acquired if known is None else acquired.join(known.select("case_id"), "case_id", "left_anti")
    return first_copies(fresh)


def duplicates(acquired: DataFrame, known: DataFrame) -> DataFrame:
    """Messages that are already a case, with that case."""
    return acquired.join(known.select("case_id", "case_ref"), "case_id")


def winners(raw: DataFrame, known: DataFrame | None) -> DataFrame:
    """``new_messages`` of raw messages, whose bytes move for the winners only, if at all.

    Keys are made where the bytes are and stored beside them; the keys alone are compared with each
    other and with ``known``, and what won is picked from the stored rows by number (by a broadcast where
    the numbers are few, else by a join).
    """
    stored = durable_table(accepted(acquire(raw)).withColumn("_row", F.monotonically_increasing_id()), "acquired")
    fresh = new_messages(stored.select("case_id", "acquired_at", "filename", "_row"), known)
    return stored.join(fresh.select("_row"), "_row", "left_semi").drop("_row")


def case_tables(analysed: DataFrame, prefixes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables derived from analysed messages alone, with networks where ``prefixes`` are given."""
    def unknown(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
        return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items()})

    hops = hop_rows(analysed, *KEYS)
    origins = analysed.select(
        *KEYS, "feos_ip", "boundary_seq", "origin_confidence", "confidence_breakdown",
        "claim_text", F.to_date("sent_at").alias("evaluated_for_date"),
    )
    return {
        "email_artifacts": analysed.select(
            *KEYS, "sha256", "size_bytes", "filename", "source", "acquired_at", "parse_status",
        ),
        "email_headers": header_rows(analysed, *KEYS),
        "received_hops": unknown(hops, _HOP_NETWORK) if prefixes is None else enrich_hops(hops, prefixes),
        "auth_results": auth_rows(analysed, *KEYS),
        "origin_assessment": unknown(origins, _ORIGIN_NETWORK) if prefixes is None else enrich_origin(origins, prefixes),
        "findings": finding_rows(analysed, *KEYS),
        "indicators": message_indicators(analysed, *KEYS),
        "dna_fingerprints": fingerprint(analysed, *KEYS),
        "cases": analysed.select(
            *KEYS, "case_ref", F.lit("complete").alias("status"), "score", "band",
            "classification", "data_completeness", "weights_version", "controls_applied",
            F.col("acquired_at").alias("created_at"),
        ),
    }


def link_tables(store: CaseStore, dna: DataFrame, seq: int) -> dict[str, DataFrame]:
    """Forms, sketches, block keys, links and component changes of a batch's fingerprints.

    Only pairs with a new form are compared. Components of stored forms are contracted to one node each,
    so the graph that is walked is that of the batch's links. Of them those are kept that decide on members
    and components; stored sketches and keys give the others again (``linkage.new_links``).
    """
    forms, stored_forms = durable_table(linkage.distinct_forms(dna), "forms"), store.read("dna_forms")
    known = None if stored_forms is None else durable_table(linkage.merged_forms(stored_forms), "stored_forms")
    new = forms if known is None else durable_table(forms.join(known.select("fp_id"), "fp_id", "left_anti"), "new_forms")
    sketched = durable_table(linkage.sketches(new), "sketches")
    parts = {name: store.read(f"link_{name}") for name in ("elements", "trigrams", "large")}
    built = None in parts.values()
    index = linkage.link_index(sketched) if built else linkage.LinkIndex(**{n: t.drop("batch_id") for n, t in parts.items()})
    keys = durable_table(linkage.block_keys(sketched, index), "block_keys")
    old_sketches, old_keys = store.read("dna_sketches"), store.read("dna_block_keys")
    links = linkage.new_links(
        sketched, keys, None if old_sketches is None else old_sketches.drop("batch_id"), None if old_keys is None else old_keys.drop("batch_id"),
        strongest=1,
    )
    everywhere = forms if known is None else linkage.merged_forms(forms.unionByName(known))
    copied = everywhere.join(forms.select("fp_id"), "fp_id", "left_semi")
    if known is not None:  # forms that had copies before link to themselves already
        copied = copied.join(known.where("copies > 1").select("fp_id"), "fp_id", "left_anti")
    links = durable_table(links.unionByName(linkage.copy_links(copied)), "links")
    placed = store.latest("components", "fp_id")
    changes = durable_table(merge_components(links, placed), "components")
    tables = {
        "dna_forms": forms, "dna_sketches": sketched, "dna_block_keys": keys, "links": links,
        "components": changes.withColumn("seq", F.lit(seq)),
    }
    return tables | ({f"link_{name}": table for name, table in index.tables().items()} if built else {})


def member_changes(store: CaseStore, linked: dict[str, DataFrame], dna: DataFrame, indicators: DataFrame, seq: int) -> DataFrame:
    """Members whose campaign or strongest link a batch may have changed, as they are now."""
    def all_of(name: str, new: DataFrame) -> DataFrame:
        stored = store.read(name)
        return new if stored is None else stored.select(*new.columns).unionByName(new)

    links, forms = linked["links"], linkage.merged_forms(all_of("dna_forms", linked["dna_forms"]))
    ends = links.select(F.col("a_fp").alias("fp_id")).unionByName(links.select(F.col("b_fp").alias("fp_id")))
    touched = durable_table(
        ends.unionByName(linked["components"].select("fp_id")).unionByName(linked["dna_forms"].select("fp_id")).distinct(), "touched_forms"
    )
    every = all_of("links", links)
    theirs = every.join(touched.withColumnRenamed("fp_id", "a_fp"), "a_fp", "left_semi").unionByName(
        every.join(touched.withColumnRenamed("fp_id", "b_fp"), "b_fp", "left_semi")
    ).distinct()
    best = linkage.best_links(forms, theirs).join(touched, "fp_id", "left_semi")
    placed, changed = store.latest("components", "fp_id"), linked["components"].select("fp_id", "component")
    if placed is not None:
        changed = changed.unionByName(placed.select("fp_id", "component").join(changed, "fp_id", "left_anti"))
    cases = linkage.with_form_id(all_of("dna_fingerprints", dna)).select("org_id", "case_id", "fp_id")
    members = cases.join(best.join(changed, "fp_id"), ["org_id", "fp_id"]).select(
        "org_id", F.sha2(F.concat_ws("\u0000", "org_id", "component"), 256).alias("campaign_id"), "case_id",
        F.least("dna_score", F.lit(1.0)).alias("dna_score"), "locus_breakdown", "partner_case",
    )
    values = all_of("indicators", indicators)
    return with_shared_indicators(durable_table(members, "members"), values, indicator_idf(values)).withColumn("seq", F.lit(seq))


def campaign_changes(store: CaseStore, members: DataFrame, cases: DataFrame, indicators: DataFrame, seq: int) -> DataFrame:
    """Campaigns with a changed member, rolled up over all their members; known ones keep their name."""
    current = store.latest("campaign_members", "case_id")
    whole = members.select("org_id", "campaign_id", "case_id")
    if current is not None:
        whole = whole.unionByName(current.select(*whole.columns).join(members.select("case_id"), "case_id", "left_anti"))
    mine = whole.join(members.select("campaign_id").distinct(), "campaign_id", "left_semi")
    rolled = campaign_rollup(durable_table(mine, "campaign_cases"), cases, indicators, named=False)
    return next_campaign_names(rolled, store.latest("campaigns", "campaign_id")).withColumn("seq", F.lit(seq))


def ingest_batch(
    raw: DataFrame,
    root: str,
    config: AnalysisConfig = AnalysisConfig(),
    org_config: DataFrame | None = None,
    batch: str | None = None,
    prefixes: DataFrame | None = None,
    snapshot: DataFrame | None = None,
    model_output: DataFrame | None = None,
) -> str:
    """Analyse a batch and add it to the tables under ``root``; returns the batch's name.

    A batch named before and committed is left alone; one that was cut off is done again over its own
    partitions. ``prefixes`` attribute networks, ``snapshot`` gives DNS re-checks, ``model_output``
    (case_id, attack_type, signals, input_sha256, output_sha256) what a model said: each adds its
    tables and its stage in the chain.
    """
    spark, batch = raw.sparkSession, batch or uuid.uuid4().hex
    store = CaseStore(spark, root)
    if store.committed(batch):
        return batch
    seq = store.next_seq()
    fresh = winners(raw, store.known()).withColumn("ingest_date", F.to_date("acquired_at"))
    analysed = durable_table(analyse_messages(fresh, config, org_config), "staged")
    stored_cases = store.read("cases")
    refs = spark.createDataFrame([], "org_id string, case_ref string") if stored_cases is None else stored_cases
    numbers = next_case_refs(analysed.select("org_id", "case_id", "acquired_at"), refs.select("org_id", "case_ref"))
    numbered = analysed.join(durable_table(numbers.select("case_id", "case_ref"), "case_numbers"), "case_id")
    numbered = durable_table(numbered, "numbered")
    tables = case_tables(numbered, prefixes)
    for name in ("indicators", "dna_fingerprints", "received_hops", "origin_assessment", "cases"):
        tables[name] = durable_table(tables[name], name)
    if snapshot is not None:
        tables["auth_rechecks"] = recheck_dkim(numbered, snapshot, *KEYS, config=config).drop("key_published").unionByName(
            dmarc_policies(numbered, snapshot, *KEYS, config=config).select(*KEYS, "mechanism", "role", "result_recomputed", "d_domain", "policy"),
            allowMissingColumns=True,
        )
    linked = link_tables(store, tables["dna_fingerprints"], seq)
    tables |= linked
    members = durable_table(member_changes(store, linked, tables["dna_fingerprints"], tables["indicators"], seq), "member_changes")
    tables["campaign_members"] = members
    every_case = tables["cases"] if stored_cases is None else stored_cases.select(*tables["cases"].columns).unionByName(tables["cases"])
    values, stored_values = tables["indicators"], store.read("indicators")
    every_value = values if stored_values is None else stored_values.select(*values.columns).unionByName(values)
    campaigns = durable_table(campaign_changes(store, members, every_case, every_value, seq), "campaign_changes")
    tables["campaigns"] = campaigns
    base = durable_table(stage_chain(numbered, "ingest_date"), "base_chain")
    more = later_events(
        numbered, None if prefixes is None else tables["received_hops"], None if prefixes is None else tables["origin_assessment"], model_output,
        members, campaigns, linkage.top_member_links(members, every_case),
    )
    later = build_chain(more, tails=chain_tails(base)).withColumn("ingest_date", F.to_date("ts_utc"))
    chain = durable_table(base.unionByName(later.select(*base.columns)), "chain")
    tables["evidence_events"] = chain
    documents = durable_table(case_documents(numbered, chain, members), "documents")
    roots = merkle_roots(merkle_leaves(chain))
    registry = spark.createDataFrame([], "case_id string, version int")
    tables["reports"] = register_reports(documents, registry, roots)
    for name, rows in tables.items():
        store.write(name, rows, batch)
    store.add_known(tables["cases"].select("case_id"), batch)
    store.commit(batch, seq)
    return batch
