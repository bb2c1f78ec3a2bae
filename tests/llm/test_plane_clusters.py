"""Clusters by bit planes against whole-number arithmetic in Python."""

import collections
import hashlib
import math
import random

import numpy as np

from relaytrail.llm import plane_clusters


def by_hand(rows, k=16, rounds=3, dim=64, scale=64):
    kept = []
    for ident, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v):
            kept.append((ident, [math.floor(x * scale) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        for ident, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            yield ident, v, d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v, c, _ in assign():
            groups[c].append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if groups[c] else old for c, old in enumerate(centroids)]
    done = list(assign())
    sums = collections.Counter()
    for _, _, c, d in done:
        sums[c] += d
    long = lambda x: x if x < 1 << 63 else None
    total = None if any(d >= 1 << 63 for *_, d in done) else long(sum(sums.values()))
    for ident, _, c, d in done:
        whole = all(e < 1 << 63 for _, _, f, e in done if f == c)
        text = ",".join(map(str, centroids[c]))
        yield ident, c, long(d), long(sums[c]) if whole else None, total, text, hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, extra=(), kind="float"):
    schema = f"vec_id long, embedding array<{kind}>" + "".join(f", `{c}` string" for c in extra)
    df = spark.createDataFrame([(i, v, *extra) for i, v in rows], schema).repartition(3)
    got = plane_clusters.cluster_vectors(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(by_hand([(r.vec_id, r.embedding) for r in df.collect()]))


def vectors(n, seed=1, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(64)]) for i in range(n)]


def test_awkward_vectors(spark):
    rows = vectors(60)
    rows += [(None, None), (60, None), (61, []), (62, [0.5] * 63), (63, [0.5] * 65), (64, [float("nan")] + [0.0] * 63), (65, [float("-inf")] + [0.0] * 63)]
    rows += [(66, [None] + [0.0] * 63), (67, [0.0] * 64), (68, [-0.0] * 64), (69, [-0.001] * 64), (70, [1.0 / 64] * 64), (71, [-1.0] * 64)]
    rows += [(72, rows[0][1])] * 3 + [(i, rows[5][1]) for i in range(80, 120)]
    check(spark, rows, extra="id cluster planes n ones distance inertia vector".split())


def test_few_and_no_vectors(spark):
    check(spark, vectors(3))
    check(spark, vectors(1) * 5)
    check(spark, [])
    check(spark, [(1, None)])


def test_wide_components_stay_exact(spark):
    wide = [(100 + i, [(-1.0) ** i * 10.0 ** (i + 2) * (j - 30) for j in range(64)]) for i in range(30)]
    check(spark, vectors(40) + wide, kind="double")


def test_means_are_floored_and_far_starts_keep_their_place(spark):
    rows = [(i, [((-1) ** (i + j)) * (i % 7) / 64 for j in range(64)]) for i in range(50)]
    check(spark, rows)


def test_planes_hold_every_number():
    rng = np.random.default_rng(2)
    values = np.floor(rng.normal(0, 50, (20, 70)))
    values[3, 4], values[5, 6] = -(2.0**40), 2.0**40
    packed = plane_clusters.pack(values)
    whole = [[int(x) for x in row] for row in values]
    assert [plane_clusters.unpack(v, 70) for v in packed] == whole
    assert [plane_clusters.unpack(v, 70) for v in plane_clusters.pack_whole(whole)] == whole
    want = [[sum(a * b for a, b in zip(x, y)) for y in whole[:4]] for x in whole]
    assert plane_clusters.dots(packed, plane_clusters.pack_whole(whole[:4])).tolist() == want
    assert plane_clusters.norms(packed).tolist() == [sum(a * a for a in x) for x in whole]
