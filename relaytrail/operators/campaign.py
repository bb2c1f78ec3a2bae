"""Campaigns: connected components over links, members and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaytrail.functions.net import ip_prefix
from relaytrail.operators.durable import durable, durable_table
from relaytrail.operators.linkage import (
    best_links, copy_links, distinct_forms, form_links, shared_indicators, with_form_id,
)
from relaytrail.operators.numbering import campaign_names


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an undirected edge list ``src, dst``.

    Alternates large-star and small-star steps until the edges stop changing: every node points
    at the smallest node it knows, and the number of rounds grows with the logarithm of the
    graph. Each round is two equi-joins and is checkpointed, so lineage stays short.
    """
    current = durable(
        edges.select(
            F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")
        ).distinct()
    )
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    current = current.where("u <> v")
    signature = None
    while True:
        current = durable(_small_star(_large_star(current)))
        state = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if (state.n, state.h) == signature:
            break
        signature = (state.n, state.h)
    pointed = current.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = pointed.select(F.col("component").alias("node"), "component").distinct()
    linked = pointed.unionByName(roots)
    alone = loops.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(alone)


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node next to it."""
    both = edges.select("u", "v").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    )
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(smallest, "u").select(F.col("m").alias("u"), "v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(smallest, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
    direct = smallest.select(F.col("m").alias("u"), "v")
    return moved.where("u <> v").unionByName(direct).distinct()


def campaign_members(dna: DataFrame, links: DataFrame | None = None, forms: DataFrame | None = None) -> DataFrame:
    """Campaign of every linked case with its strongest link.

    Components are found between distinct fingerprints; copies follow their form. Of ``links`` those
    of ``form_links`` with ``strongest`` are enough.
    """
    forms = distinct_forms(dna) if forms is None else forms
    if links is None:
        links = form_links(forms, strongest=1).unionByName(copy_links(forms))
    best = best_links(forms, links)
    components = connected_components(
        links.select(F.col("a_fp").alias("src"), F.col("b_fp").alias("dst"))
    )
    placed = best.join(components, best["fp_id"] == components["node"]).drop("node")
    members = with_form_id(dna).select("org_id", "case_id", "fp_id")
    return members.join(placed, ["org_id", "fp_id"]).select(
        "org_id",
        F.sha2(F.concat_ws("\u0000", "org_id", "component"), 256).alias("campaign_id"),
        "case_id",
        F.least("dna_score", F.lit(1.0)).alias("dna_score"),
        "locus_breakdown",
        "partner_case",
    )


def with_shared_indicators(members: DataFrame, indicators: DataFrame, idf: DataFrame) -> DataFrame:
    """Members with the discriminative values they share with their strongest partner.

    One pair a member, so the cost is that of the members and not of all linked pairs.
    """
    pairs = members.select("org_id", "case_id", F.col("partner_case").alias("other_case")).distinct()
    shared = shared_indicators(pairs, indicators, idf).withColumnRenamed("other_case", "partner_case")
    return members.join(shared, ["org_id", "case_id", "partner_case"], "left").withColumns({
        "shared_count": F.coalesce("shared_count", F.lit(0)), "shared_indicators": F.coalesce("shared_indicators", F.array().cast("array<string>")),
    })


def merge_components(links: DataFrame, placed: DataFrame | None) -> DataFrame:
    """(fp_id, component) of the forms that new links place or move.

    ``placed`` (fp_id, component) are the components so far. Each of them is one node, so what is
    walked is the graph of the new links; only forms whose component changes are listed. A component
    is named by its smallest form, as in one run over all links.
    """
    ends = links.select(F.col("a_fp").alias("fp_id")).unionByName(links.select(F.col("b_fp").alias("fp_id"))).distinct()
    if placed is None:
        found = connected_components(links.select(F.col("a_fp").alias("src"), F.col("b_fp").alias("dst")))
        return found.select(F.col("node").alias("fp_id"), "component")
    old = placed.select("fp_id", "component")
    known = durable_table(ends.join(old, "fp_id", "left"), "link_ends")
    at = lambda side: known.select(F.col("fp_id").alias(side), F.coalesce("component", "fp_id").alias(f"{side}_node"))
    contracted = links.select("a_fp", "b_fp").join(at("a_fp"), "a_fp").join(at("b_fp"), "b_fp")
    found = connected_components(contracted.select(F.col("a_fp_node").alias("src"), F.col("b_fp_node").alias("dst"))).withColumnRenamed("component", "new")
    fresh = known.where("component IS NULL").join(found, known["fp_id"] == found["node"]).select("fp_id", F.col("new").alias("component"))
    moved = found.where("node <> new").select(F.col("node").alias("component"), "new")
    return fresh.unionByName(old.join(moved, "component").select("fp_id", F.col("new").alias("component")))


def campaign_rollup(members: DataFrame, cases: DataFrame, indicators: DataFrame, named: bool = True) -> DataFrame:
    """Size, highest score, first and last sighting, distinct domains and addresses.

    ``distinct_prefixes`` counts addresses, as its consumers expect; ``distinct_networks``
    counts the /24 and /48 prefixes.
    """
    base = (
        members.join(cases.select("org_id", "case_id", "score", "created_at"), ["org_id", "case_id"])
        .groupBy("org_id", "campaign_id")
        .agg(
            F.count(F.lit(1)).alias("member_count"),
            F.max("score").alias("max_score"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
        )
    )
    # one row per campaign and value before counting, so no count holds a set
    values = (
        members.select("org_id", "campaign_id", "case_id")
        .join(
            indicators.where(F.col("type").isin("domain", "ip")).select(
                "org_id", "case_id", "type", "normalised"
            ),
            ["org_id", "case_id"],
        )
        .select("org_id", "campaign_id", "type", "normalised")
        .distinct()
    )
    networks = (
        values.where("type = 'ip'")
        .select("org_id", "campaign_id", ip_prefix(F.col("normalised")).alias("network"))
        .distinct()
        .groupBy("org_id", "campaign_id")
        .agg(F.count(F.lit(1)).alias("distinct_networks"))
    )
    counts = values.groupBy("org_id", "campaign_id").agg(
        F.count_if(F.col("type") == "domain").alias("distinct_domains"),
        F.count_if(F.col("type") == "ip").alias("distinct_prefixes"),
    )
    joined = base.join(counts, ["org_id", "campaign_id"], "left").join(
        networks, ["org_id", "campaign_id"], "left"
    )
    counted = joined.fillna(0, ["distinct_domains", "distinct_prefixes", "distinct_networks"])
    return campaign_names(counted) if named else counted
