"""Centroid clustering of integer vectors held as bit planes.

A vector's components become integers and each of its bit planes is packed into one 64-bit word for
every 64 components, in two's complement. The dot product of two vectors is then the sum of
``weight(p) * weight(q) * popcount(plane p of one AND plane q of the other)``: whole numbers only, so
distances are exact. Vectors are packed once and written to the shared folder; every round is one
scan that sends a row of bit counts for each centroid and plane from each task, whatever the number
of vectors near that centroid.

Defined results: vectors that are null, of another length, or with a null or non-finite component
(after scaling, too) are left out; fewer vectors than centroids give as many centroids as vectors; an
empty table gives an empty result. Null ids are kept and start no centroid before others do; repeated
ids and rows are vectors of their own, and of equal start keys the smaller packed vector comes first.
Equal distances go to the smaller centroid number. Ids keep their type; other columns are ignored.
Components of any width are exact; a distance or inertia that no long can hold is null. Vectors are
of one length, so there are no very long rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relaytrail.llm.common import durable_table, inline_rows

WORD = 64
#: Planes up to which every distance of 2**9 components at most fits in 64 bits.
NARROW = 26
#: Vectors compared with all centroids at a time.
BLOCK = 4096


def pack(values: np.ndarray) -> np.ndarray:
    """(n, planes, words) of whole numbers given as doubles; the last plane is the sign."""
    n, dim = values.shape
    words, top = -(-dim // WORD), np.abs(values).max(initial=0.0)
    planes = max(2, 1 + int(np.frexp(top)[1]))
    bits = np.zeros((n, planes, words * WORD), np.uint8)
    for p in range(planes):
        # both steps are exact in doubles: a scaling by a power of two and a floor
        bits[:, p, :dim] = np.mod(np.floor(np.ldexp(values, -p)), 2)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")


def pack_whole(rows: list[list[int]]) -> np.ndarray:
    """The same of Python integers."""
    width = max(2, 1 + max(abs(x).bit_length() for row in rows for x in row))
    words = -(-len(rows[0]) // WORD)
    bits = np.zeros((len(rows), width, words * WORD), np.uint8)
    for i, row in enumerate(rows):
        for j, x in enumerate(row):
            for p in range(width):
                bits[i, p, j] = x >> p & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")


def plane_weights(planes: int) -> list[int]:
    return [1 << p for p in range(planes - 1)] + [-(1 << (planes - 1))]


def unpack(planes: np.ndarray, dim: int) -> list[int]:
    """The components of one packed vector."""
    bits = np.unpackbits(planes.view(np.uint8), axis=1, bitorder="little")[:, :dim]
    return [sum(w * int(b) for w, b in zip(plane_weights(len(planes)), column)) for column in bits.T]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of all vectors of ``a`` with all of ``b``: weighted AND-popcounts."""
    kind = np.int64 if max(a.shape[1], b.shape[1]) <= NARROW else object
    out = np.zeros((len(a), len(b)), kind)
    for p, wp in enumerate(plane_weights(a.shape[1])):
        for q, wq in enumerate(plane_weights(b.shape[1])):
            common = np.bitwise_count(a[:, None, p] & b[None, :, q]).sum(axis=2, dtype=np.int64)
            out += common.astype(kind) * (wp * wq)
    return out


def norms(a: np.ndarray) -> np.ndarray:
    kind = np.int64 if a.shape[1] <= NARROW else object
    out, weights = np.zeros(len(a), kind), plane_weights(a.shape[1])
    for p, wp in enumerate(weights):
        for q, wq in enumerate(weights):
            out += np.bitwise_count(a[:, p] & a[:, q]).sum(axis=1, dtype=np.int64).astype(kind) * (wp * wq)
    return out


def nearest(a: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each vector; the first of equally near ones."""
    distances = norms(a)[:, None] - 2 * dots(a, centroids) + norms(centroids)[None, :]
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(a)), cluster]


def _blocks(batch: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, planes) of a batch's packed vectors, the narrower ones extended by their sign.

    The rare vectors of many planes come in small blocks of their own.
    """
    vectors = [np.frombuffer(v, "<u8").reshape(-1, words) for v in batch.column(1).to_pylist()]
    widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for rows, size in ((np.flatnonzero(widths <= NARROW), BLOCK), (np.flatnonzero(widths > NARROW), 64)):
        for block in np.split(rows, range(size, len(rows), size)) if len(rows) else []:
            out = np.empty((len(block), widths[block].max(), words), "<u8")
            for i, row in enumerate(block.tolist()):
                v = vectors[row]
                out[i, : len(v)] = v
                out[i, len(v) :] = v[-1]
            yield block, out


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: float) -> DataFrame:
    """(id, planes) of the vectors that count: floor(scale * x) of each component x, as bit planes."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    # nan counts as larger than infinity, so it fails the comparison too
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf")))
    kept = rows.where((F.size("vector") == dim) & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                planes = pack(np.floor(flat.reshape(-1, dim) * scale))
                size = planes[0].nbytes
                data = pa.Array.from_buffers(
                    pa.binary(), len(planes), [None, pa.py_buffer(np.arange(len(planes) + 1, dtype=np.int32) * size), pa.py_buffer(planes.tobytes())]
                )
                yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["id", "planes"])

    return kept.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, planes binary")


def _bit_counts(packed: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """(cluster, plane, n, ones): how many members of a cluster have each component's bit set.

    A sign plane of weight -2**(p-1) is numbered -p, as tasks may see vectors of different widths.
    """
    words, k = centroids.shape[2], len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(dim, np.int64))
        members: dict[int, int] = defaultdict(int)
        for batch in batches:
            for _, planes in _blocks(batch, words):
                cluster, _ = nearest(planes, centroids)
                width = planes.shape[1]
                bits = np.unpackbits(planes.view(np.uint8), axis=2, bitorder="little")[:, :, :dim]
                chosen = np.zeros((k, len(planes)))
                chosen[cluster, np.arange(len(planes))] = 1
                counts = (chosen @ bits.reshape(len(planes), -1).astype(np.float64)).astype(np.int64).reshape(k, width, dim)
                for c in np.unique(cluster).tolist():
                    members[c] += int((cluster == c).sum())
                    for p in range(width):
                        ones[c, p if p < width - 1 else -width] += counts[c, p]
        keys = list(ones)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int32()),
                pa.array([members[c] if p == 0 else 0 for c, p in keys], pa.int64()),
                pa.array([ones[key].tolist() for key in keys], pa.list_(pa.int64())),
            ],
            names=["cluster", "plane", "n", "ones"],
        )

    partial = packed.mapInArrow(run, "cluster int, plane int, n long, ones array<long>")
    sums = [F.sum(F.col("ones")[j]).alias(f"ones_{j}") for j in range(dim)]
    return partial.groupBy("cluster", "plane").agg(F.sum("n").alias("n"), *sums)


def _moved(packed: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The floored means of the clusters; an empty cluster's centroid stays."""
    totals, members = defaultdict(lambda: [0] * dim), defaultdict(int)
    # bounded: one row for each centroid and plane
    for row in _bit_counts(packed, pack_whole(centroids), dim).collect():
        weight = 1 << row.plane if row.plane >= 0 else -(1 << (-row.plane - 1))
        members[row.cluster] += row.n
        totals[row.cluster] = [t + weight * ones for t, ones in zip(totals[row.cluster], row[3:])]
    return [[t // members[c] for t in totals[c]] if members[c] else old for c, old in enumerate(centroids)]


def _long(number: int | None) -> int | None:
    return number if number is not None and number < 1 << 63 else None


def _assigned(packed: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    words = centroids.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, planes in _blocks(batch, words):
                cluster, distance = nearest(planes, centroids)
                held = [d if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(cluster, pa.int32()), pa.array(held, pa.int64())],
                    names=["id", "cluster", "distance"],
                )

    return packed.mapInArrow(run, f"id {id_type}, cluster int, distance long")


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector that counts.

    The ``k`` start vectors are those with the least SHA-256 of ``1:<id>``.
    """
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    packed = durable_table(packed_vectors(vectors, id_col, vector_col, dim, scale), "bit_planes")
    words = -(-dim // WORD)
    start = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256)
    first = packed.select(start.alias("h"), "planes").orderBy(F.col("h").asc_nulls_last(), "planes").limit(k).collect()
    centroids = [unpack(np.frombuffer(r.planes, "<u8").reshape(-1, words), dim) for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = _moved(packed, centroids, dim)
    if not centroids:
        centroids = [[0] * dim]  # of an empty table: no vector will look at it
    rows = durable_table(_assigned(packed, pack_whole(centroids), id_type), "clusters")

    # bounded: a row for each centroid
    sums = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count("distance").alias("held"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")
    ).collect()
    of = {r.cluster: int(r.s) if r.n == r.held else None for r in sums}
    inertia = _long(None if None in of.values() else sum(of.values()))
    facts = []
    for i, c in enumerate(centroids):
        text = ",".join(map(str, c))
        facts.append((i, _long(of.get(i, 0)), inertia, text, hashlib.sha256(text.encode()).hexdigest()))
    schema = "cluster int, cluster_inertia long, inertia long, centroid string, centroid_sha256 string"
    return rows.join(F.broadcast(inline_rows(spark, facts, schema)), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )
