"""SimHash near-dedup over vantage-point trees.

A fingerprint is the bitwise majority of the XXH64 hashes of a document's word shingles. Vantage points
deal the fingerprints out to shards by Hamming distance. Over all 64 bits nearly every random
fingerprint lies near a boundary, so distances are taken on ``radius // 2 + 1`` parts of the bits:
distances on disjoint parts add up, so two fingerprints within ``radius`` (4) bits are within one bit on
at least one of the (3) parts. A tree over a part therefore prunes by the triangle bound with a margin
of one bit: a fingerprint whose distance to the vantage point is just inside the boundary also enters
the shard outside it, all others enter one shard, and no pair is lost.

Levels of the tree above the shards come from the number of distinct fingerprints, so a shard keeps its
size as the input grows; below, each shard builds its own trees with vantage points among its points,
down to leaves that are compared directly with all 64 bits. A point enters about 1.17 shards a
level and a shard holds 0.58 of the one above it, so n fingerprints cost about n ** 1.3 comparisons.
Points that no part tells apart (a dense group) go through a tree over all bits, which compares
across a boundary only what lies within the radius of it. A shard that stays very large is cut into
distance bands around three vantage points, with the same margin.

Only distinct fingerprints enter the trees and a shard gives out links to one representative of
each connected set, so copies and dense groups cost no pairs.

Defined results: a null text has no words and the fingerprint zero, as an empty one; null ids never
name a component unless it has no other; repeated rows share a fingerprint; texts of any length are
read whole; equal distances fall on the same side, and of equal roots the least fingerprint stands for
the set; an empty table gives an empty result; other columns are ignored. Ids are taken as long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from relaytrail.llm.common import LOWER, UPPER, durable_table, identity, small_batches, wrapped
from relaytrail.llm.components import connected_components

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Distinct fingerprints that the vantage levels aim at for a shard.
SHARD_POINTS = 4096
#: A shard this many times above it, which only a dense group can fill, is cut into distance bands.
DENSE = 16
#: What a level leaves of a shard: half of the points, and the sixth on the boundary in half the cases.
SHRINK = 0.584
#: Points of a tree's leaf, compared with each other directly.
LEAF = 128
#: Width of a distance band; more than the radius, so that only the next band can hold a partner.
BAND = 8
VANTAGE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit majority of the shingles' hashes, repeats included; zero without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    spans = zip((0, *(e + i + 1 for i, e in enumerate(ends[: len(words) - shingle]))), (e + i for i, e in enumerate(ends[shingle - 1 :], shingle - 1)))
    hashed = xxhash.xxh64_intdigest
    hashes = [hashed(joined[a:b], seed) for a, b in spans] if len(words) >= shingle else [hashed(joined, seed)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *carried, texts = batch.columns
        signed = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*carried, pa.array(signed)], [*batch.schema.names[:-1], "fp"])


def row_key(id_col: str, text_col: str) -> list[Column]:
    return identity(F.col(id_col).cast("long"), text_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; with ``keyed`` also the hashes (_u1, _u2) of its id and text."""
    small_batches(docs.sparkSession)
    keys = row_key(id_col, text_col) if keyed else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *keys, F.col(text_col).alias("text")).mapInArrow(
        _fingerprints, "doc_id long, _u1 long, _u2 long, fp long" if keyed else "doc_id long, fp long"
    )


def part_masks(radius: int = RADIUS) -> list[int]:
    """Disjoint masks over the 64 bits: points within ``radius`` are within one bit on some mask."""
    parts = radius // 2 + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


class Links:
    """Union-find over array positions; keeps the least position as root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            parent = self.roots()
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            high, low = np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ]
            np.minimum.at(self.parent, high, low)


def _near(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, radius: int, links: Links) -> None:
    step = max(1, (1 << 21) // max(1, len(y)))
    for i in range(0, len(x), step):
        a, b = np.nonzero(np.bitwise_count(x[i : i + step, None] ^ y[None, :]) <= radius)
        links.join(at_x[i + a], at_y[b])


def tree_links(points: np.ndarray, radius: int, links: Links, at: np.ndarray | None = None) -> None:
    """Join all points within ``radius`` bits: a vantage-point tree walked as it is built."""
    stack = [np.arange(len(points)) if at is None else at]
    while stack:
        at = stack.pop()
        if len(at) <= LEAF:
            _near(points[at], points[at], at, at, radius, links)
            continue
        distance = np.bitwise_count(points[at] ^ points[at[len(at) // 2]])
        split = int(np.median(distance))
        inner = distance <= split
        if inner.all():  # more than half at the largest distance: split below it
            split -= 1
            inner = distance <= split
        stack += [at[inner], at[~inner]]
        # only points within the radius of the boundary can have a partner on its other side,
        # and a partner's distance to the vantage point differs by the radius at most
        for d in range(max(0, split - radius + 1), split + 1):
            near = at[distance == d]
            far = at[~inner & (distance <= d + radius)]
            if len(near) and len(far):
                _near(points[near], points[far], near, far, radius, links)


def part_links(points: np.ndarray, mask: int, margin: int, radius: int, links: Links) -> None:
    """Join all points within ``margin`` bits on ``mask`` and ``radius`` in all: the tree of a shard.

    The boundary is the one whose two sides have the least squares. Where even that saves under
    a fifth of the comparisons, the part does not tell the points apart and all bits are used.
    """
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) <= LEAF:
            _near(points[at], points[at], at, at, radius, links)
            continue
        part = points[at] & np.uint64(mask)
        distance = np.bitwise_count(part ^ part[len(at) // 2])
        upto = np.cumsum(np.bincount(distance, minlength=65)).astype(float)
        outside = len(at) - np.r_[np.zeros(margin), upto[: 65 - margin]]
        cost = upto**2 + outside**2
        split = int(np.argmin(cost))
        if cost[split] > 0.8 * len(at) ** 2:
            tree_links(points, radius, links, at)
        else:
            stack += [at[distance <= split], at[distance > split - margin]]


def _shard_links(radius: int, margin: int):
    masks = part_masks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, part, fp) sorted by shard; gives (fp, representative) for fingerprints with a link."""
        held: list[np.ndarray] = []
        last, mask = None, 0

        def linked():
            points = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
            if len(points) < 2:
                return None
            links = Links(len(points))
            part_links(points, mask, margin, radius, links)
            roots = links.roots()
            moved = roots != np.arange(len(points))
            if not moved.any():
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(points[moved].view(np.int64)), pa.array(points[roots[moved]].view(np.int64))], ["u", "v"]
            )

        for batch in batches:
            shard = np.asarray(batch.column(0))
            part = np.asarray(batch.column(1))
            points = np.asarray(batch.column(2)).view(np.uint64)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for run_of_shard, first in zip(np.split(points, cuts), np.r_[0, cuts] if len(shard) else ()):
                if shard[first] != last:
                    if (out := linked()) is not None:
                        yield out
                    held, last, mask = [], shard[first], masks[part[first]]
                held.append(run_of_shard)
        if (out := linked()) is not None:
            yield out

    return run


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _distance(vantage: int | Column, mask: int = (1 << 64) - 1) -> Column:
    vantage = F.lit(_signed(vantage)) if isinstance(vantage, int) else vantage
    return F.bit_count(F.col("fp").bitwiseXOR(vantage).bitwiseAND(F.lit(_signed(mask)))).cast("int")


def _paths(mask: int, margin: int, vantage: list[int]) -> Column:
    """All paths (a bit for each vantage point) by which ``fp`` goes down: outside is 1, inside 0."""
    split = mask.bit_count() // 2

    def level(paths: Column, point: Column) -> Column:
        d = _distance(point, mask)
        sides = F.when(d > split, F.array(F.lit(1))).when(d > split - margin, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return F.flatten(F.transform(paths, lambda path: F.transform(sides, lambda side: path * 2 + side)))

    return F.aggregate(F.array(*[F.lit(_signed(v)) for v in vantage]).cast("array<bigint>"), F.array(F.lit(0).cast("bigint")), level)


def _bands(radius: int) -> Column:
    bands = F.array(F.lit(0))
    for v in VANTAGE:
        d = _distance(v)
        own = F.floor(d / BAND).cast("int")
        near = F.when((d % BAND < radius) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
        bands = F.flatten(F.transform(bands, lambda band: F.transform(near, lambda digit: band * 16 + digit)))
    return bands


def vantage_levels(n: int, shard_points: int = SHARD_POINTS) -> int:
    return min(60, max(0, ceil(log(max(n, 1) / shard_points, 1 / SHRINK))))


def vantage_shards(points: DataFrame, radius: int, levels: int) -> DataFrame:
    """(fp, part, shard) of every shard that a fingerprint enters, ``levels`` vantage points deep in each part."""
    margin = radius // (radius // 2 + 1)
    parts = [
        F.struct(F.lit(i).alias("part"), _paths(m, margin, [xxhash.xxh64_intdigest(f"{i}:{k}", SEED) for k in range(levels)]).alias("paths"))
        for i, m in enumerate(part_masks(radius))
    ]
    return (
        points.select("fp", F.inline(F.array(*parts)))
        .select("fp", "part", F.explode("paths").alias("path"))
        .select("fp", "part", F.xxhash64("part", "path").alias("shard"))
    )


def near_links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other."""
    shards = vantage_shards(points, radius, vantage_levels(points.count(), shard_points))
    dense = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DENSE * shard_points)
    routed = (
        shards.join(dense.select("shard", F.lit(True).alias("dense")), "shard", "left")
        .select("fp", "part", "shard", F.explode(F.when(F.col("dense"), _bands(radius)).otherwise(F.array(F.lit(-1)))).alias("band"))
        .select(F.xxhash64("shard", "band").alias("shard"), "part", "fp")
    )
    return routed.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _shard_links(radius, radius // (radius // 2 + 1)), "u long, v long"
    )


def named_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(root, fp, component_id) of every distinct fingerprint."""
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(points.select("fp"), radius))
    named = points.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    components = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(components, "root").select("root", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = durable_table(fingerprints(docs, id_col, text_col), "fingerprints")
    return prints.join(named_prints(prints, radius).select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the least id, and of its texts the least hash.

    A row with an id goes before rows without one, and of rows that agree in id and text any one stays.
    """
    prints = durable_table(fingerprints(docs, id_col, text_col, keyed=True), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_u1", "_u2")
    least = prints.join(named_prints(prints).select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("first"))
    u1, u2 = row_key(id_col, text_col)
    rows = wrapped(docs, _u1=u1, _u2=u2).join(least.select("first._u1", "first._u2"), ["_u1", "_u2"], "left_semi")
    once = Window.partitionBy("_u1", "_u2").orderBy("_u1")
    return rows.withColumn("n", F.row_number().over(once)).filter("n = 1").select("row.*")
