"""Centroid clustering against plain integer loops."""

import hashlib
import math

import numpy as np
import pytest

from flowlens.llm.centroids import cluster_vectors

NAN, INF = float("nan"), float("inf")


def plain(rows, k, rounds, dims, seed=3):
    """(id, vector) -> rows of (id, cluster, distance), inertia per cluster and centroids, in Python's integers."""
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]

    def rank(row):
        i, v = row
        return (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v)

    centroids = [v for _, v in sorted(kept, key=rank)[:k]]

    def nearest(v):
        return min((sum((x - c) ** 2 for x, c in zip(v, m)), n) for n, m in enumerate(centroids))

    for _ in range(rounds):
        near = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, near) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, c in final if c == n) for n in range(len(centroids))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digests[c]) for i, d, c in final), key=repr), centroids


def run(spark, rows, kind="array<float>", **settings):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding {kind}, cluster int, v string")
    found, centroids = cluster_vectors(table.repartition(3), **settings)
    return sorted((tuple(r) for r in found.collect()), key=repr), [list(c) for c in centroids]


def test_clusters_equal_plain_loops(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(5, 6))
    rows = [(i, (middle[i % 5] + rng.normal(size=6) * 0.4).astype("float32").tolist()) for i in range(240)]
    rows += [(900 + i, rows[0][1]) for i in range(80)]  # copies of one vector
    odd = [(500, None), (501, []), (502, [0.0] * 5), (503, [0.0] * 7), (504, [NAN] + [0.0] * 5), (505, [INF] + [0.0] * 5)]
    odd += [(506, [None] + [0.0] * 5), (507, [0.0] * 6), (3, rows[3][1]), (None, rows[4][1]), (508, [-0.00001] * 6)]
    for k, rounds in ((8, 10), (3, 1), (1, 2)):
        assert run(spark, rows + odd, k=k, rounds=rounds, dims=6) == plain(rows + odd, k, rounds, 6)


def test_ties_few_rows_and_empty_tables(spark):
    same = [(i, [0.5, -0.5]) for i in range(6)]
    assert run(spark, same, dims=2) == plain(same, 8, 10, 2)  # all centroids alike: cluster 0 takes all
    assert {r[1] for r in run(spark, same, dims=2)[0]} == {0}
    two = [(7, [1.0, 2.0]), (8, [3.0, 4.0])]
    assert run(spark, two, dims=2) == plain(two, 8, 10, 2)
    found, centroids = cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.collect() == [] and centroids == []
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("size", [1e5, 1e7])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * size).tolist()) for i in range(60)]
    top = 2**63 - 1
    want, centroids = plain(rows, 4, 5, 4)
    want = [tuple(None if isinstance(x, int) and x > top else x for x in r) for r in want]
    assert run(spark, rows, "array<double>", k=4, rounds=5, dims=4) == (want, centroids)


def test_components_beyond_the_bound_are_held(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 1.0])]
    found, centroids = run(spark, rows, "array<double>", k=2, rounds=2, dims=2)
    assert [r[0] for r in found] == [1, 2, 3] and all(abs(x) <= 1 << 57 for c in centroids for x in c)
