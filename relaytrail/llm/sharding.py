"""Sharding: best-fit-decreasing bin packing of indivisible groups into fixed-capacity shards.

A group (all rows with one text) is never divided, unless it alone is larger than a shard; then it
is cut into chunks by a hash of the row. Packing runs at two levels, each with the same packer:
every partition packs its groups into parcels of a fixed small capacity; the parcels (at most two
per capacity of their bytes, and one more for each partition) are packed into the shards on the
driver. The parcel capacity is a fixed fraction of a shard, so the number of parcels does not grow
with the corpus.

Defined results: a null text counts as empty, with size 1; repeated rows are rows of one group; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from relaytrail.llm.common import durable_table, inline_rows, text_of

#: Parcels per shard: a parcel is this fraction of a shard.
PARCELS = 512
#: Rows of a shard that are numbered in one sort.
CELL_ROWS = 200_000


class _Node:
    __slots__ = ("key", "level", "left", "right")

    def __init__(self, key) -> None:
        self.key, self.level, self.left, self.right = key, 1, None, None


class BalancedTree:
    """An AA tree of distinct keys: insert, remove, and the least key not below a bound."""

    def __init__(self) -> None:
        self.root = None

    def ceiling(self, bound):
        node, found = self.root, None
        while node is not None:
            if node.key >= bound:
                node, found = node.left, node.key
            else:
                node = node.right
        return found

    def insert(self, key) -> None:
        self.root = self._insert(self.root, key)

    def remove(self, key) -> None:
        self.root = self._remove(self.root, key)

    @staticmethod
    def _skew(node):
        if node is not None and node.left is not None and node.left.level == node.level:
            left = node.left
            node.left, left.right = left.right, node
            return left
        return node

    @staticmethod
    def _split(node):
        if node is not None and node.right is not None and node.right.right is not None and node.right.right.level == node.level:
            right = node.right
            node.right, right.left = right.left, node
            right.level += 1
            return right
        return node

    def _insert(self, node, key):
        if node is None:
            return _Node(key)
        if key < node.key:
            node.left = self._insert(node.left, key)
        else:
            node.right = self._insert(node.right, key)
        return self._split(self._skew(node))

    def _remove(self, node, key):
        if node is None:
            return None
        if key < node.key:
            node.left = self._remove(node.left, key)
        elif key > node.key:
            node.right = self._remove(node.right, key)
        elif node.left is None and node.right is None:
            return None
        elif node.left is None:
            heir = node.right
            while heir.left is not None:
                heir = heir.left
            node.key, node.right = heir.key, self._remove(node.right, heir.key)
        else:
            heir = node.left
            while heir.right is not None:
                heir = heir.right
            node.key, node.left = heir.key, self._remove(node.left, heir.key)
        least = min(node.left.level if node.left else 0, node.right.level if node.right else 0) + 1
        if least < node.level:
            node.level = least
            if node.right is not None and least < node.right.level:
                node.right.level = least
        node = self._skew(node)
        node.right = self._skew(node.right)
        if node.right is not None:
            node.right.right = self._skew(node.right.right)
        node = self._split(node)
        node.right = self._split(node.right)
        return node


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: by falling size into the fullest bin that still has room for it.

    An item above the capacity gets a bin of its own.
    """
    bins, free, n = [0] * len(sizes), BalancedTree(), 0
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        found = free.ceiling((size, -1))
        if found is None:
            found = (capacity, n)
            n += 1
        else:
            free.remove(found)
        bins[item] = found[1]
        if found[0] > size:
            free.insert((found[0] - size, found[1]))
    return bins


def fewest_capacity(sizes: list[int], shards: int) -> list[int]:
    """Bins of the least capacity (to a ten-thousandth) at which the items need no more than ``shards``."""
    if not sizes:
        return []
    low = max(-(-sum(sizes) // shards), max(sizes))
    step = max(1, low // 20_000)
    capacity, stride = low, step
    while max(bins := best_fit_decreasing(sizes, capacity)) >= shards:
        capacity, stride = capacity + stride, stride * 2
    if capacity > low:  # halve back over the last stride
        bad, good = capacity - stride // 2, capacity
        while good - bad > step:
            middle = (good + bad) // 2
            tried = best_fit_decreasing(sizes, middle)
            if max(tried) < shards:
                good, bins = middle, tried
            else:
                bad = middle
    return bins


def _parcels(capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]  # 50 bytes for each group of this partition
        if not held:
            return
        groups = pd.concat(held, ignore_index=True)
        bins = best_fit_decreasing(groups["bytes"].tolist(), capacity)
        groups["bin"] = bins
        # a parcel is named by its least member, so a repeated task gives the same names
        groups["parcel"] = groups.groupby("bin")["name"].transform("min")
        yield groups[["sha", "chunk", "bytes", "parcel"]]

    return pack


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; shards of nearly equal bytes."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text_of(text_col)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text_col)).alias("text_crc32"), F.unhex(F.sha2(text_of(text_col), 256)).alias("sha"),
    )
    groups = durable_table(rows.groupBy("sha").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard_groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    capacity = max(1, -(-total // shards))
    chunk = F.lit(0)
    giants = [bytes(r.sha) for r in groups.filter(F.col("bytes") > capacity).select("sha").collect()]  # fewer than shards
    if giants:
        hot = F.col("sha").isin(*[F.lit(g) for g in giants])
        chunk = F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(shards * 16)).cast("int")).otherwise(0)
        groups = rows.withColumn("chunk", chunk).groupBy("sha", "chunk").agg(F.sum("size").alias("bytes"))
    else:
        groups = groups.withColumn("chunk", F.lit(0))
    parcel_capacity = max(1, capacity // PARCELS)
    named = groups.select("sha", "chunk", "bytes", F.concat(F.hex("sha"), F.lit("-"), F.col("chunk")).alias("name"))
    parcels = durable_table(
        named.repartition("sha", "chunk").mapInPandas(_parcels(parcel_capacity), "sha binary, chunk int, bytes long, parcel string"),
        "shard_parcels",
    )
    # at most 2 * shards * PARCELS parcels and one for each partition, whatever the corpus
    items = parcels.groupBy("parcel").agg(F.sum("bytes").alias("bytes")).orderBy("parcel").collect()
    bins = fewest_capacity([r["bytes"] for r in items], shards)
    placed = spark.createDataFrame([(r["parcel"], b) for r, b in zip(items, bins)], "parcel string, shard int")
    homes = parcels.join(placed, "parcel").select("sha", "chunk", "shard")
    cells = max(1, -(-n_rows // CELL_ROWS))
    assigned = durable_table(
        rows.withColumn("chunk", chunk).join(homes, ["sha", "chunk"])
        .select("doc_id", "size", "text_crc32", "sha", "shard", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(cells)).alias("cell")),
        "sharded",
    )
    return numbered(assigned)


def numbered(assigned: DataFrame) -> DataFrame:
    """Gapless slots in every shard: ranks inside cells of bounded size plus the cells before them."""
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        assigned.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "sha")
    return (
        assigned.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).alias("slot"))
    )


def pack_groups(groups: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """(shard, bytes) of the fewest shards of a fixed ``capacity`` for a table of group ``bytes``."""
    parcels = groups.mapInPandas(_parcels(max(1, capacity // PARCELS)), "sha binary, chunk int, bytes long, parcel string")
    items = parcels.groupBy("parcel").agg(F.sum("bytes").alias("bytes")).orderBy("parcel").collect()
    sizes = [r["bytes"] for r in items]
    filled: dict[int, int] = {}
    for b, s in zip(best_fit_decreasing(sizes, capacity), sizes):
        filled[b] = filled.get(b, 0) + s
    return sorted(filled.items())
