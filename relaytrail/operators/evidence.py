"""Chain of custody: building, verifying and committing to per-case event chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relaytrail.functions.canonical import canonical_hash, canonical_json, decimal_text, moment

_BLOCK_BITS = 10
_BLOCK = 1 << _BLOCK_BITS


def _stages(actor: str) -> Column:
    """The deterministic stages of an analysed row, in order, with their payload hashes."""
    auth = F.transform(
        "auth_results",
        lambda r: F.struct(
            r["aligned"].alias("aligned"), r["mechanism"].alias("mechanism"),
            r["result_reported"].alias("result"),
        ),
    )
    groups = F.map_from_entries(
        F.array_sort(
            F.transform(
                "group_scores", lambda g: F.struct(g["signal_group"], decimal_text(g["score"]))
            )
        )
    )
    payloads = (
        (actor, "acquired", {
            "sha256": F.col("sha256"), "size_bytes": F.col("size_bytes"),
            "filename": F.lit(None).cast("string"),
        }),
        ("service:parser", "parsed", {
            "headers": F.size("headers"), "received_hops": F.size("hops"),
            "urls": F.size("urls"),
            "attachments": F.transform("attachments", lambda a: a["sha256"]),
        }),
        ("service:auth", "auth_evaluated", {
            "trusted_authserv": F.col("trusted_authserv_id"), "results": auth,
            "discarded_headers": F.col("discarded_headers"),
            "forged_pass_detected": F.col("forged_pass_detected"),
        }),
        ("service:origin", "origin_reconstructed", {
            "feos_ip": F.col("feos_ip"), "boundary_hop_seq": F.col("boundary_seq"),
            "confidence": F.col("origin_confidence"), "flags": F.col("origin_flags"),
        }),
        ("service:scoring", "scored", {
            "score": F.col("score"), "band": F.col("band"),
            "classification": F.col("classification"), "group_scores": groups,
            "finding_rule_ids": F.array_sort(F.transform("findings", lambda f: f["rule_id"])),
        }),
    )
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(who).alias("actor"), F.lit(action).alias("action"),
                canonical_hash(fields).alias("payload_hash"),
            )
            for i, (who, action, fields) in enumerate(payloads)
        ]
    )


def stage_events(analysed: DataFrame, actor: str = "collector") -> DataFrame:
    """Events of the deterministic stages of a case, in order, with their payload hashes."""
    return analysed.select("org_id", "case_id", F.col("acquired_at").alias("ts_utc"), F.inline(_stages(actor)))


def stage_chain(analysed: DataFrame, *carried: str, actor: str = "collector") -> DataFrame:
    """The chain of ``stage_events``, linked inside the row: the stages of a case are one array.

    No shuffle and no Python; equal to ``build_chain(stage_events(analysed))``.
    """
    rows = analysed.select("org_id", "case_id", F.col("acquired_at").alias("ts_utc"), *carried, _stages(actor).alias("_stages"))

    def link(so_far: Column, event: Column) -> Column:
        head, tail = _entry_parts(event)
        previous = F.get(so_far, F.size(so_far) - 1)["entry_hash"]
        entry = F.struct(
            event["actor"].alias("actor"), event["action"].alias("action"), event["payload_hash"].alias("payload_hash"),
            F.size(so_far).cast("long").alias("seq"), previous.alias("prev_hash"),
            _linked(head, previous, F.size(so_far), tail).alias("entry_hash"),
        )
        return F.concat(so_far, F.array(entry))

    none = F.array().cast(
        "array<struct<actor:string,action:string,payload_hash:string,seq:bigint,prev_hash:string,entry_hash:string>>"
    )
    return rows.select("org_id", "case_id", "ts_utc", *carried, F.inline(F.aggregate("_stages", none, link)))


def later_events(
    analysed: DataFrame, hops: DataFrame | None, origins: DataFrame | None, model_output: DataFrame | None,
    members: DataFrame | None, campaigns: DataFrame | None, links: DataFrame | None,
) -> DataFrame:
    """Events of the stages after the analysis: ``enriched``, ``ai_analysed``, ``campaign_linked``.

    Each stage comes from the table it left, and a case without a row there has no such event:
    ``hops`` and ``origins`` with networks, ``model_output`` (case_id, attack_type, signals,
    input_sha256, output_sha256), and members with their campaign and strongest ``links``.
    """
    cases = analysed.select("org_id", "case_id", F.col("acquired_at").alias("ts_utc"))

    def events(rows: DataFrame, number: int, actor: str, action: str, fields: dict) -> DataFrame:
        return rows.select(
            "org_id", "case_id", "ts_utc", F.lit(number).alias("ord"), F.lit(actor).alias("actor"), F.lit(action).alias("action"),
            canonical_hash(fields).alias("payload_hash"),
        )

    found = cases.select("*", F.lit(0).alias("ord"), F.lit("").alias("actor"), F.lit("").alias("action"), F.lit("").alias("payload_hash")).limit(0)
    if hops is not None and origins is not None:
        counts = hops.groupBy("case_id").agg(F.count_if(F.col("net_type").isNotNull() | F.col("asn").isNotNull()).alias("hops_enriched"))
        rows = cases.join(counts, "case_id", "left").join(origins.select("case_id", "geo_dataset"), "case_id", "left")
        found = found.unionByName(events(rows, 5, "service:enrichment", "enriched", {
            "hops_enriched": F.coalesce("hops_enriched", F.lit(0)), "feos_source": F.col("geo_dataset"),
        }))
    if model_output is not None:
        rows = cases.join(model_output.select("case_id", "attack_type", "signals", "input_sha256", "output_sha256"), "case_id")
        found = found.unionByName(events(rows, 6, "service:ai", "ai_analysed", {
            k: F.col(k) for k in ("attack_type", "signals", "input_sha256", "output_sha256")
        }))
    if members is not None:
        named = members.select("org_id", "campaign_id", "case_id").join(campaigns.select("org_id", "campaign_id", "name"), ["org_id", "campaign_id"])
        rows = cases.join(named.select("case_id", "name"), "case_id").join(links, "case_id")
        listed = F.transform("links", lambda x: F.concat_ws("|", x["case_ref"], decimal_text(x["score"])))
        found = found.unionByName(events(rows, 7, "service:campaign", "campaign_linked", {"campaign": F.col("name"), "links": listed}))
    return found


def _entry_parts(event: Column | None = None) -> tuple[Column, Column]:
    """Canonical entry before the previous hash, and after the sequence number.

    Keys in order: action, actor, case_id, payload_hash, prev_hash, seq, ts_utc. The event's own
    fields are those of ``event``, or of the row.
    """
    own = {k: F.col(k) if event is None else event[k] for k in ("action", "actor", "payload_hash")}
    head = canonical_json(
        {
            "action": own["action"], "actor": own["actor"],
            "case_id": F.col("case_id").cast("string"), "payload_hash": own["payload_hash"],
        }
    )
    return (
        F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"prev_hash":')),
        F.concat(F.lit(',"ts_utc":"'), moment(F.col("ts_utc")), F.lit('"}')),
    )


def entry_hash(prev_hash: Column, seq: Column) -> Column:
    """Hash of an event row; the one formula that building and verifying share."""
    head, tail = _entry_parts()
    return _linked(head, prev_hash, seq, tail)


def _linked(head: Column, prev_hash: Column, seq: Column, tail: Column) -> Column:
    quoted = F.coalesce(F.concat(F.lit('"'), prev_hash, F.lit('"')), F.lit("null"))
    return F.sha2(F.concat(head, quoted, F.lit(',"seq":'), seq.cast("string"), tail), 256)


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link sorted rows; only the current case, number and hash are held."""
    case, seq, previous = None, 0, None
    for batch in batches:
        columns = batch.to_pydict()
        seqs, prevs, hashes = [], [], []
        for case_id, head, tail, last_seq, last_hash in zip(
            columns["case_id"], columns["_head"], columns["_tail"],
            columns["_last_seq"], columns["_last_hash"], strict=True,
        ):
            if case_id != case:
                case, previous = case_id, last_hash
                seq = 0 if last_seq is None else last_seq + 1
            link = "null" if previous is None else f'"{previous}"'
            digest = hashlib.sha256(f'{head}{link},"seq":{seq}{tail}'.encode()).hexdigest()
            seqs.append(seq)
            prevs.append(previous)
            hashes.append(digest)
            previous, seq = digest, seq + 1
        keep = [i for i, n in enumerate(batch.schema.names) if not n.startswith("_")]
        arrays = [batch.column(i) for i in keep]
        names = [batch.schema.names[i] for i in keep]
        yield pa.RecordBatch.from_arrays(
            arrays + [pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
            names + ["seq", "prev_hash", "entry_hash"],
        )


def build_chain(
    events: DataFrame, order: str = "ord", tails: DataFrame | None = None
) -> DataFrame:
    """Number and link the events of every case in ``order``.

    Input: org_id, case_id, ts_utc, actor, action, payload_hash and the order column.
    ``tails`` (case_id, seq, entry_hash) continues chains that exist already. Each entry's hash
    feeds the next, so a case is sequential by nature: rows are sorted by case on disk-backed
    shuffles and streamed past a constant amount of state, never gathered, and everything that
    can be computed per row is computed before.
    """
    head, tail = _entry_parts()
    keyed = events.withColumn("_head", head).withColumn("_tail", tail)
    if tails is None:
        keyed = keyed.withColumn("_last_seq", F.lit(None).cast("long")).withColumn(
            "_last_hash", F.lit(None).cast("string")
        )
    else:
        last = tails.select(
            "case_id", F.col("seq").cast("long").alias("_last_seq"),
            F.col("entry_hash").alias("_last_hash"),
        )
        keyed = keyed.join(last, "case_id", "left")
    columns = ["org_id", "case_id", "ts_utc", "actor", "action", "payload_hash"]
    ordered = keyed.select(
        *columns, "_head", "_tail", "_last_seq", "_last_hash", F.col(order).alias("_order")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.select(*columns).schema)
    return (
        ordered.repartition("case_id")
        .sortWithinPartitions("case_id", "_order")
        .mapInArrow(_chain_batches, f"{schema}, seq long, prev_hash string, entry_hash string")
    )


def chain_tails(chain: DataFrame) -> DataFrame:
    """Last number and hash of every chain."""
    return chain.groupBy("case_id").agg(
        F.max(F.struct("seq", "entry_hash")).alias("t")
    ).select("case_id", "t.seq", "t.entry_hash")


_REASON_HASH = "entry hash does not match a recomputation from the stored fields"
_REASON_LINK = "prev_hash does not match the preceding event, or the sequence has a gap"


def verify_events(chain: DataFrame) -> DataFrame:
    """Check every stored event: its hash, its link and its place in the sequence.

    Each event meets its predecessor in a join on (case, number - 1), so a long chain is spread
    like any other rows. An event is out of place when any number before it is missing.
    """
    before = chain.select(
        "case_id", (F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("_expected")
    )
    joined = chain.join(before, ["case_id", "seq"], "left")
    gap_here = (F.col("seq") > 0) & F.col("_expected").isNull()
    gaps = joined.where(gap_here).groupBy("case_id").agg(F.min("seq").alias("_gap"))
    checked = joined.join(gaps, "case_id", "left")
    placed = F.coalesce(F.col("seq") < F.col("_gap"), F.lit(True))
    return checked.select(
        *chain.columns,
        F.coalesce(entry_hash(F.col("prev_hash"), F.col("seq")) == F.col("entry_hash"), F.lit(False))
        .alias("hash_ok"),
        (F.col("prev_hash").eqNullSafe(F.col("_expected")) & placed).alias("link_ok"),
    ).withColumn(
        "reason", F.when(~F.col("hash_ok"), _REASON_HASH).when(~F.col("link_ok"), _REASON_LINK)
    )


def chain_summary(cases: DataFrame, verified: DataFrame) -> DataFrame:
    """Per case: intact, number of events, first broken event and a sentence.

    A case without events is not intact.
    """
    broken = ~(F.col("hash_ok") & F.col("link_ok"))
    summary = verified.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(broken).alias("broken_count"),
        F.min(F.when(broken, F.struct("seq", "action", "reason"))).alias("first"),
    )
    joined = cases.select("case_id").join(summary, "case_id", "left")
    n = F.coalesce("event_count", F.lit(0))
    return joined.select(
        "case_id",
        n.alias("event_count"),
        F.coalesce((F.col("broken_count") == 0) & (n > 0), F.lit(False)).alias("intact"),
        F.col("first.seq").alias("first_broken_seq"),
        F.when(n == 0, "No evidence events recorded for this case.")
        .when(
            F.col("first").isNull(),
            F.concat(
                F.lit("All "), n.cast("string"),
                F.lit(" events verify: every hash recomputes and every link matches its predecessor."),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Chain BROKEN at event "), F.col("first.seq").cast("string"), F.lit(" ("),
                F.col("first.action"), F.lit("): "), F.col("first.reason"),
                F.lit(". Events after this point cannot be relied upon."),
            )
        )
        .alias("summary"),
    )


def pair_hash(left: Column, right: Column) -> Column:
    return F.sha2(F.unhex(F.concat(left, right)), 256)


def _next_level(level: Column) -> Column:
    """One step up; a node without a partner is carried unchanged."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")),
        lambda i: F.coalesce(
            pair_hash(F.get(level, i * 2), F.get(level, i * 2 + 1)), F.get(level, i * 2)
        ),
    )


def _block_levels(leaves: Column) -> Column:
    """All levels of one block of at most 1024 aligned nodes, leaves first."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_BLOCK_BITS)),
        F.array(leaves),
        lambda levels, _: F.concat(levels, F.array(_next_level(F.element_at(levels, -1)))),
    )


def _blocks(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes (key, pos, hash) gathered in aligned blocks of at most 1024."""
    return nodes.groupBy(key, F.floor(F.col("pos") / _BLOCK).alias("block")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]
        ).alias("nodes")
    )


def _rounds(leaves: DataFrame) -> int:
    """How often blocks have to be folded: one round per ten levels."""
    highest = leaves.agg(F.max("pos")).first()[0] or 0
    rounds = 1
    while highest >= _BLOCK:
        highest >>= _BLOCK_BITS
        rounds += 1
    return rounds


def merkle_leaves(chain: DataFrame, key: str = "case_id") -> DataFrame:
    """Leaves (key, pos, hash) of chains whose numbers start at 0 without gaps."""
    return chain.select(key, F.col("seq").alias("pos"), F.col("entry_hash").alias("hash"))


def merkle_roots(leaves: DataFrame, key: str = "case_id") -> DataFrame:
    """Root per key over its leaves (key, pos, hash) in order.

    Ten levels are folded per shuffle inside blocks of at most 1024 nodes, so the leaves of one
    key are spread over many tasks.
    """
    nodes = leaves.select(key, "pos", "hash")
    for _ in range(_rounds(leaves)):
        folded = _block_levels(F.col("nodes"))
        nodes = _blocks(nodes, key).select(
            key, F.col("block").alias("pos"), F.get(F.element_at(folded, -1), 0).alias("hash")
        )
    return nodes.select(key, F.col("hash").alias("merkle_root"))


def merkle_nodes(leaves: DataFrame, key: str = "case_id") -> DataFrame:
    """Every node of every tree: (key, level, pos, hash)."""
    nodes, out, base = leaves.select(key, "pos", "hash"), None, 0
    for _ in range(_rounds(leaves)):
        levels = (
            _blocks(nodes, key)
            .select(key, "block", F.posexplode(_block_levels(F.col("nodes"))).alias("up", "row"))
            .select(key, "block", "up", F.posexplode("row").alias("at", "hash"))
        )
        part = levels.select(
            key,
            (F.col("up") + base).alias("level"),
            (F.shiftleft(F.col("block").cast("long"), _BLOCK_BITS) / F.pow(F.lit(2), "up") + F.col("at"))
            .cast("long")
            .alias("pos"),
            "hash",
        )
        top = part.where(F.col("level") == base + _BLOCK_BITS)
        nodes = top.select(key, "pos", "hash")
        lower = part.where(F.col("level") < base + _BLOCK_BITS)
        out = lower if out is None else out.unionByName(lower)
        base += _BLOCK_BITS
    return out.unionByName(nodes.select(key, F.lit(base).alias("level"), "pos", "hash"))


def merkle_proofs(leaves: DataFrame, key: str = "case_id", wanted: DataFrame | None = None) -> DataFrame:
    """Audit path of every leaf, or of the ``wanted`` ones (key, pos).

    One row per leaf and level with a sibling: (key, pos, level, sibling, side).
    """
    nodes = merkle_nodes(leaves, key).select(
        key, "level", F.col("pos").alias("at"), F.col("hash").alias("sibling")
    )
    chosen = leaves.select(key, "pos") if wanted is None else wanted.select(key, "pos")
    depth = _rounds(leaves) * _BLOCK_BITS
    steps = chosen.select(
        key, "pos", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
    ).withColumn(
        "_node", F.floor(F.col("pos") / F.pow(F.lit(2), "level")).cast("long")
    )
    asked = steps.withColumn("at", F.col("_node").bitwiseXOR(F.lit(1).cast("long")))
    return asked.join(nodes, [key, "level", "at"]).select(
        key, "pos", "level", "sibling",
        F.when(F.col("at") > F.col("_node"), "right").otherwise("left").alias("side"),
    )


def proof_root(leaf: Column, path: Column) -> Column:
    """Root reached from a leaf along an array of (sibling, side)."""
    return F.aggregate(
        path,
        leaf,
        lambda current, step: F.when(
            step["side"] == "left", pair_hash(step["sibling"], current)
        ).otherwise(pair_hash(current, step["sibling"])),
    )


def verify_proofs(leaves: DataFrame, proofs: DataFrame, roots: DataFrame, key: str = "case_id") -> DataFrame:
    """Whether every leaf's path leads to its key's root."""
    # bounded: one path has as many steps as the tree has levels
    paths = proofs.groupBy(key, "pos").agg(
        F.array_sort(F.collect_list(F.struct("level", "sibling", "side"))).alias("path")
    )
    joined = leaves.join(paths, [key, "pos"], "left").join(roots, key)
    empty = F.array().cast("array<struct<level:int,sibling:string,side:string>>")
    path = F.coalesce("path", empty)
    return joined.select(
        key, "pos", F.size(path).alias("steps"),
        (proof_root(F.col("hash"), path) == F.col("merkle_root")).alias("proof_ok"),
    )
