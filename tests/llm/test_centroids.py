"""Centroid clustering against plain Python, and its edges."""

import hashlib
import math
import random

import numpy as np
import pytest

from sonoshelf.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    return sorted([(i, c, d, sum(e for _, b, e in found if b == c), total, hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found], key=repr)


def told(df):
    return sorted([tuple(r)[:6] for r in df.drop("read").collect()], key=repr)


def vectors(n, seed, spread=0.3):
    r = random.Random(seed)
    tops = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(tops)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_clusters_are_those_of_brute_force(spark, seed):
    rows = vectors(200, seed) + [(1000 + i, [0.0] * 64) for i in range(40)] + [(500, None), (501, [1.0] * 63), (502, [math.nan] * 64), (503, [math.inf] + [0.0] * 63), (504, [None] + [0.0] * 63), (None, [0.5] * 64), (3, [0.25] * 64)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cluster", "'x' AS id").repartition(4)
    assert told(C.cluster(df)) == brute(rows)


def test_large_components_stay_exact(spark):
    r = random.Random(1)
    rows = [(i, [float(np.float32(r.choice([1.0, 2e5, -3e5, 1e6, 0.3]) * r.random())) for _ in range(64)]) for i in range(60)]
    assert told(C.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_sums_that_no_long_holds_are_null(spark):
    rows = [(i, [(-1.0) ** i * 7e16] * 64) for i in range(4)] + [(9, [1e18] * 64)]
    got = C.cluster(spark.createDataFrame(rows, SCHEMA), k=1).collect()
    assert len(got) == 4 and all(r.distance is None and r.cluster_inertia is None and r.inertia is None for r in got)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(5, 9)
    assert told(C.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert C.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.cluster(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []


def test_the_transform_keeps_distances():
    x = np.random.default_rng(0).integers(-999, 999, (50, 64))
    w = C.transform(x)
    assert (((w[0] - w) ** 2).sum(1) == 64 * ((x[0] - x) ** 2).sum(1)).all()
    assert sorted(C.by_sequency()) == list(range(64)) and C.by_sequency()[0] == 0


@pytest.mark.parametrize("kind", [np.int64, object])
def test_search_is_exact_and_keeps_ties(kind):
    g = np.random.default_rng(2)
    x, c = g.integers(-3, 3, (300, 64)), g.integers(-3, 3, (20, 64))
    c[7], c[15], x[5] = c[3], c[3], c[3]
    x[6] = (c[1] + c[2]) // 2
    cluster, distance, read = C.nearest(x.astype(kind), c.astype(kind))
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all() and cluster[5] == 3
    assert read.min() >= 64 and read.max() <= 64 * 20


def test_smooth_vectors_drop_most_centroids_early():
    g = np.random.default_rng(3)
    smooth = lambda n: np.repeat(g.integers(-500, 500, (n, 4)), 16, axis=1)
    _, _, read = C.nearest(smooth(500), smooth(16))
    assert read.mean() < 0.25 * 64 * 16
