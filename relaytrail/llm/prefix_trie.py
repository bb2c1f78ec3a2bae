"""Prefix trie of conversations: every shared run of first turns is a node.

Turns become digests at once, so no text is shuffled. A conversation is cut into blocks of ``WIDTH``
turns, one positional column each, and a block is keyed by the node that the block before it ends at:
the sums of two 64-bit hashes of (place, turn) over all turns before it, which blocks of any number
get from running sums instead of one after the other. One ``GROUP BY key, ROLLUP(t1, ..., t8)`` over
all blocks then aggregates all prefixes together, and ``grouping_id`` tells their depth.

Sums over subtrees need no walk: every node belongs to its smallest member, so the nodes of a
conversation are the end of its path, and a subtree's nodes are those of its members, less what its
smallest member has above it. A second roll-up of the conversations that own nodes adds them up.

Defined results: null roles and texts are empty; turns are ordered by number, null first, equal
numbers by the digest of role and text; repeated rows are turns of their own. Rows without a
conversation id belong to none and are left out. Only ``conv_id % 100`` (with the sign of the id) says
where a conversation starts from. Very long texts are hashed where they are; very long conversations
spread over tasks, by ranges of their turns and by blocks. The digest of the conversations that end at
a node has to be computed in order: sorted ids become pieces of text in parallel, and one task streams
the pieces of a node past its hash. An empty table has no conversations and gives no node, not even a
root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from relaytrail.llm.common import durable_table, join_hot, out_batches

#: Turn columns of a block, and blocks of one running sum.
WIDTH, RUN = 8, 512
#: Characters of one piece of comma-joined ids.
PIECE = 1 << 20

_NODE = ["depth", "s1", "s2"]


def turn_id(role: Column, text: Column) -> Column:
    """Equal for equal (role, text) only: 128 bits of SHA-256."""
    size = F.length(role).cast("string")
    return F.substring(F.sha2(F.concat(size, F.lit(":"), role, text).cast("binary"), 256), 1, 32)


def numbered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, at, id, size): the turns of each conversation, numbered from 0.

    Turns are sorted by ranges, numbered inside each range, and shifted by what the ranges before hold,
    so a conversation of any length is sorted by as many tasks as its ranges.
    """
    empty = F.lit("")
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        turn_id(F.coalesce(F.col(role), empty), F.coalesce(F.col(text), empty)).alias("id"),
        F.char_length(F.coalesce(F.col(text), empty)).cast("long").alias("size"),
    ).where("conv_id IS NOT NULL")
    # equal rows may fall on either side of a border: they are the same turn
    ranged = durable_table(
        rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv_id", F.asc_nulls_first("turn"), "id", "row")
        .select("conv_id", "turn", "id", "size", F.spark_partition_id().alias("part")),
        "turns",
    )
    parts = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("weight"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = durable_table(parts.withColumn("shift", F.coalesce(F.sum("weight").over(earlier), F.lit(0))), "ranges")
    inside = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "id")
    local = ranged.withColumn("n", F.row_number().over(inside) - 1)
    return local.join(shifts, ["conv_id", "part"]).select("conv_id", (F.col("n") + F.col("shift")).alias("at"), "id", "size")


def rebuilt_turns(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id, at, id, size), (conv_id)) of the rebuilt conversations.

    Each takes its first turns from the conversation its family starts with, as many as its id says.
    """
    turns = durable_table(turns, "numbered")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("weight")).withColumn("taken", taken)
    # bounded: the first few turns of a conversation
    donors = (
        turns.where((F.col("conv_id") % family == 0) & (F.col("at") < heads - 1)).groupBy(F.col("conv_id").alias("donor"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "id", "size"))).alias("head"))
    )
    plan = durable_table(
        convs.withColumn("donor", F.col("conv_id") - F.col("conv_id") % family).join(donors, "donor", "left")
        .select("conv_id", "weight", "taken", F.slice(F.coalesce("head", F.array().cast("array<struct<at:bigint,id:string,size:bigint>>")), F.lit(1), F.col("taken").cast("int")).alias("head")),
        "rebuilt",
    )
    borrowed = plan.select("conv_id", F.inline("head"))
    facts = plan.select("conv_id", "weight", "taken", F.size("head").alias("shift"))
    own = join_hot(turns, facts, ["conv_id"], "weight").where("at >= taken")
    own = own.select("conv_id", (F.col("at") - F.col("taken") + F.col("shift")).alias("at"), "id", "size")
    return borrowed.unionByName(own), plan.select("conv_id")


def _hash(seed: int, at: Column, ident: Column) -> Column:
    """64 bits of a turn at its place, as a decimal that sums cannot overflow."""
    return F.xxhash64(F.lit(seed), at.cast("long"), ident).cast("decimal(38,0)")


def _zero() -> Column:
    return F.lit(0).cast("decimal(38,0)")


def turn_blocks(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(conv_id, block, k1, k2, before, t1.., l1.., e1, e2, n): a row for each block of each conversation.

    ``k1, k2`` and ``before`` are the sums of hashes and sizes over all blocks before; ``e1, e2`` are
    the block's own. Every conversation has a first block, if an empty one.
    """
    place = F.col("at") % width
    rows = turns.withColumn("block", F.floor(F.col("at") / width))
    columns = [F.max(F.when(place == i, F.col("id"))).alias(f"t{i + 1}") for i in range(width)]
    sizes = [F.max(F.when(place == i, F.col("size"))).alias(f"l{i + 1}") for i in range(width)]
    sums = [F.sum(_hash(s, F.col("at"), F.col("id"))).cast("decimal(38,0)").alias(f"e{s}") for s in (1, 2)]
    filled = rows.groupBy("conv_id", "block").agg(*columns, *sizes, *sums, F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    turnless = convs.join(filled.where("block = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("string").alias(f"t{i + 1}") for i in range(width)],
        *[F.lit(None).cast("long").alias(f"l{i + 1}") for i in range(width)], *[_zero().alias(f"e{s}") for s in (1, 2)],
        F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("n"),
    )
    blocks = durable_table(filled.unionByName(turnless), "blocks")
    # sums inside runs of blocks, then over the runs: no window holds all of a long conversation
    run = F.floor(F.col("block") / RUN)
    held = {"e1": "k1", "e2": "k2", "size": "before"}
    runs = blocks.groupBy("conv_id", run.alias("run")).agg(*[F.sum(c).alias(c) for c in held])
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"r_{c}") for c in held])
    inside = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = blocks.withColumn("run", run).select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"i_{c}") for c in held])
    kinds = {"e1": "decimal(38,0)", "e2": "decimal(38,0)", "size": "long"}
    return durable_table(
        local.join(runs, ["conv_id", "run"]).select(*blocks.columns, *[(F.col(f"r_{c}") + F.col(f"i_{c}")).cast(kinds[c]).alias(k) for c, k in held.items()]),
        "keyed_blocks",
    )


def prefixes(spark: SparkSession, blocks: DataFrame, measures: str, width: int = WIDTH) -> DataFrame:
    """All prefixes that end in each block, the root among them, with aggregates over their members.

    One roll-up of the positional columns in all blocks at once; level ``j`` of a block is depth
    ``block * width + j``. Level 0 of later blocks is the node before and is left to its own block.
    """
    turns = ", ".join(f"t{i}" for i in range(1, width + 1))
    sizes = ", ".join(f"max(l{i}) AS l{i}" for i in range(1, width + 1))
    rolled = spark.sql(
        f"""SELECT block, k1, k2, {turns}, before, {width} - bit_count(grouping_id()) AS level, {sizes}, {measures}
            FROM {{blocks}} GROUP BY block, k1, k2, before, ROLLUP({turns})""",
        blocks=blocks,
    )
    last = lambda prefix: F.element_at(F.array(*[F.col(f"{prefix}{i}") for i in range(1, width + 1)]), F.col("level"))
    # at level 0 no turn is the last one
    ends = rolled.where("(level = 0 AND block = 0) OR level > 0").withColumn("last", F.when(F.col("level") > 0, last("t")))
    ends = ends.where("level = 0 OR last IS NOT NULL").withColumn("last_size", F.coalesce(F.when(F.col("level") > 0, last("l")), F.lit(0)))
    depth = F.col("block") * width + F.col("level")

    def total(s: int) -> Column:
        out = F.col(f"k{s}")
        for i in range(width):
            out = out + F.when(F.col("level") > i, _hash(s, F.col("block") * width + i, F.col(f"t{i + 1}"))).otherwise(_zero())
        return out.cast("decimal(38,0)")

    def own(s: int) -> Column:
        return F.when(F.col("level") > 0, _hash(s, depth - 1, F.col("last"))).otherwise(_zero())

    above = F.col("before")
    for i in range(1, width + 1):
        above = above + F.when(F.col("level") > i, F.coalesce(f"l{i}", F.lit(0))).otherwise(0)
    drop = [f"{p}{i}" for p in "tl" for i in range(1, width + 1)]
    return (
        ends.withColumns({"s1": total(1), "s2": total(2), "depth": depth, "above": above})
        .withColumns({"p1": (F.col("s1") - own(1)).cast("decimal(38,0)"), "p2": (F.col("s2") - own(2)).cast("decimal(38,0)")})
        .drop(*drop, "block", "k1", "k2", "before", "level", "last")
    )


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256) of the nodes (depth, s1, s2) at which conversations (conv_id) end."""
    pieces = pa.schema([("depth", pa.int64()), ("s1", pa.decimal128(38)), ("s2", pa.decimal128(38)), ("first", pa.int64()), ("piece", pa.binary())])
    done = pa.schema([("depth", pa.int64()), ("s1", pa.decimal128(38)), ("s2", pa.decimal128(38)), ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            node, first, held, size = None, None, [], 0
            for batch in batches:
                for depth, s1, s2, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                    if node != (depth, s1, s2) or size >= PIECE:
                        if held:
                            yield *node, first, b",".join(held)
                        node, first, held, size = (depth, s1, s2), conv_id, [], 0
                    held.append(b"%d" % conv_id)
                    size += len(held[-1]) + 1
            if held:
                yield *node, first, b",".join(held)

        yield from out_batches(rows(), pieces)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            node, state = None, None
            for batch in batches:
                for depth, s1, s2, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                    if node == (depth, s1, s2):
                        state.update(b",")
                    else:
                        if node is not None:
                            yield *node, state.hexdigest()
                        node, state = (depth, s1, s2), hashlib.sha256()
                    state.update(piece)
            if node is not None:
                yield *node, state.hexdigest()

        yield from out_batches(rows(), done)

    spec = "depth long, s1 decimal(38,0), s2 decimal(38,0)"
    ordered = ends.select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    parts = durable_table(ordered.mapInArrow(join, f"{spec}, first long, piece binary"), "ends")
    return parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digest, f"{spec}, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    family: int = 100, heads: int = 6, width: int = WIDTH,
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    spark = conversations.sparkSession
    turns, convs = rebuilt_turns(numbered_turns(conversations, conv_col, turn_col, role_col, text_col), family, heads)
    blocks = turn_blocks(turns, convs, width)
    paths = durable_table(
        blocks.groupBy("conv_id").agg(
            F.sum("n").alias("depth"), F.sum("e1").cast("decimal(38,0)").alias("s1"), F.sum("e2").cast("decimal(38,0)").alias("s2"),
            F.sum("size").alias("total"), F.count(F.lit(1)).alias("weight"),
        ),
        "paths",
    )
    # every member's whole size, to be cut by what lies above a node
    sized = join_hot(blocks, paths.select("conv_id", "total", "weight"), ["conv_id"], "weight")
    nodes = durable_table(
        prefixes(spark, sized, "min(conv_id) AS conv_id, count(*) AS n_convs, sum(total) AS totals", width), "nodes"
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = durable_table(
        nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes"
    )
    # what each conversation owns: the end of its path, and a leaf if nothing goes on from there
    owners = durable_table(
        nodes.groupBy("conv_id").agg(
            F.sum("last_size").alias("owned"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), F.count(F.lit(1)).alias("weight"),
        ).join(paths.select("conv_id", "total", F.col("weight").alias("blocks")), "conv_id"),
        "owners",
    )
    owning = join_hot(blocks, owners.select("conv_id", "owned", "leaves", F.col("blocks").alias("weight")), ["conv_id"], "weight")
    below = prefixes(spark, owning, "sum(owned) AS owned_below, sum(leaves) AS n_leaves", width).select(*_NODE, "owned_below", "n_leaves")
    parents = durable_table(nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"),
    ), "parents")
    family_of = join_hot(nodes, parents, ["depth", "p1", "p2"], "weight", how="left").drop("weight")
    summed = durable_table(family_of.join(below, _NODE).join(ends_digests(paths), _NODE, "left"), "summed")
    facts = owners.select("conv_id", "owned", "total", "weight")
    whole = join_hot(summed, facts, ["conv_id"], "weight")
    # sizes of all members' turns from the node on, less those of the different nodes
    members = F.col("totals") - F.col("n_convs") * F.col("above")
    different = F.col("owned_below") - F.col("owned") + F.col("total") - F.col("above")
    return whole.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"),
        (members - different).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
