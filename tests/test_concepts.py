import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.agreement import METRICS, agreement, contingency
from flowlens.functions.special import log_factorial
from flowlens.operators.concepts import label_concepts, standardize, two_means


def test_log_factorial(spark):
    import math

    for r in spark.range(300).select("id", log_factorial("id").alias("v")).collect():
        assert r.v == pytest.approx(math.lgamma(r.id + 1), rel=1e-13, abs=1e-13)


CASES = {
    0: [(0, 0)] * 40 + [(0, 1)] * 5 + [(1, 0)] * 9 + [(1, 1)] * 31,
    1: [(0, 0)] * 20 + [(1, 1)] * 20,
    2: [(0, 1)] * 20 + [(1, 0)] * 13,
    3: [(0, 0)] * 7 + [(1, 0)] * 9,
    4: [(0, 0)] * 10 + [(0, 1)] * 10 + [(1, 0)] * 10 + [(1, 1)] * 10,
    5: [(1, 0)] * 3 + [(1, 1)] * 4,
    6: [(0, 0), (1, 1)],
    7: [(0, 0)] * 900 + [(0, 1)] * 700 + [(1, 0)] * 650 + [(1, 1)] * 810,
}


def test_agreement_follows_the_definitions(spark):
    rows = spark.createDataFrame([(k, c, x) for k, pairs in CASES.items() for c, x in pairs], "b long, concept int, cluster int")
    for r in agreement(contingency(rows, ["b"]), ["b"]).collect():
        assert [r[m] for m in METRICS] == pytest.approx(list(brute.agreement(CASES[r["b"]])), abs=1e-9), r["b"]


def test_single_cluster_and_concept(spark):
    rows = spark.createDataFrame([(0, 0, 0)] * 5, "b long, concept int, cluster int")
    row = agreement(contingency(rows, ["b"]), ["b"]).first()
    assert [row[m] for m in METRICS] == [1.0] * 6


def blobs(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for batch in range(3):
        for i in range(40):
            middle = 0.0 if i % 2 else 8.0 + batch
            rows.append((batch, rng.gauss(middle, 1), rng.gauss(-middle, 1), i % 2))
    rows += [rows[0]] * 60  # a third of all rows are copies of one
    return spark.createDataFrame(rows, "batch_id long, x double, y double, blob int")


def test_two_means_finds_blobs_whatever_the_partitions_and_the_way(spark):
    seen = []
    for parts, task_rows in ((1, 1000), (5, 1000), (1, 10), (5, 10)):
        rows = blobs(spark).repartition(parts)
        found = two_means(rows, ["x", "y"], task_rows=task_rows)
        seen.append(sorted(tuple(r) for r in found.collect()))
        mixed = found.groupBy("batch_id", "blob").agg(F.count_distinct("cluster").alias("n")).filter("n > 1")
        assert mixed.isEmpty()
        # clusters are numbered by ascending centroid: low x first
        assert found.filter("blob = 1 AND cluster = 1").isEmpty()
    assert all(one == seen[0] for one in seen)


def test_batches_do_not_influence_each_other(spark):
    rows = blobs(spark)
    together = two_means(rows, ["x", "y"], task_rows=10).filter("batch_id = 1")
    alone = two_means(rows.filter("batch_id = 1"), ["x", "y"], task_rows=10)
    assert together.exceptAll(alone).isEmpty()


def test_label_concepts_repeats_the_reference(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    new = spark.createDataFrame([(5, 3.0), (7, 4.0)], "batch_id long, x double")
    rows = sorted(tuple(r) for r in label_concepts(ref, new, ["x"], [5, 7]).collect())
    assert rows == [(5, 1.0, 0), (5, 2.0, 0), (5, 3.0, 1), (7, 1.0, 0), (7, 2.0, 0), (7, 4.0, 1)]


def test_standardize(spark):
    rows = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0)], "batch_id long, x double, y double")
    assert sorted((r.x, r.y) for r in standardize(rows, ["x", "y"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_several_starts_find_the_least_inertia_both_ways(spark):
    rng = random.Random(5)
    rows = []
    for batch in range(3):
        # two clouds, and one row so far out that the farthest pair alone would cut off just that row
        cloud = [(batch, i % 2, rng.gauss(10.0 * (i % 2), 1), rng.gauss(0, 1)) for i in range(60)]
        rows += cloud + [(batch, 1, 5.0, 60.0 + batch), (batch, 0, None, 1.0), (batch, 0, float("nan"), 1.0)]
    table = spark.createDataFrame(rows, "batch_id long, concept int, x double, y double").persist()

    def inertia(found):
        total = 0.0
        for batch in range(3):
            for cluster in (0, 1):
                mine = [(r.x, r.y) for r in found if r.batch_id == batch and r.cluster == cluster]
                mean = [sum(v) / len(mine) for v in zip(*mine)]
                total += sum((x - mean[0]) ** 2 + (y - mean[1]) ** 2 for x, y in mine)
        return total

    one = two_means(table, ["x", "y"], tolerance=0.0).collect()
    ways = [two_means(table, ["x", "y"], tolerance=0.0, starts=3, task_rows=n).collect() for n in (1, 10_000)]
    assert sorted(map(str, ways[0])) == sorted(map(str, ways[1]))
    assert inertia(ways[0]) <= inertia(one) + 1e-6
    assert sum(r.cluster is None for r in ways[0]) == 6 and len(ways[0]) == len(rows)


def lloyd(x, a, b):
    """Plain steps until no centroid moves: the sides, the inertia and how many steps it took."""
    for steps in range(1, 10_000):
        near_b = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
        new = x[~near_b].mean(axis=0), x[near_b].mean(axis=0)
        moved = not (np.array_equal(new[0], a) and np.array_equal(new[1], b))
        a, b = new
        if not moved:
            break
    side = near_b if tuple(a) < tuple(b) else ~near_b
    return side.astype(int), np.minimum(((x - a) ** 2).sum(axis=1), ((x - b) ** 2).sum(axis=1)).sum(), steps


def test_large_batches_take_fewer_jobs_than_steps(spark):
    x = np.random.default_rng(4).normal(size=(6000, 3))  # no clusters, so the border turns slowly
    x[:, 0] *= 1.02
    far = lambda point: x[((x - point) ** 2).sum(axis=1).argmax()]
    starts = [(far(x.mean(axis=0)), far(far(x.mean(axis=0))))]
    starts += [(x[x[:, c].argmin()], x[x[:, c].argmax()]) for c in np.argsort(-x.var(axis=0))[:2]]
    ends = [lloyd(x, *pair) for pair in starts]
    want = min(ends, key=lambda end: end[1])[0]
    rows = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(x)], "batch_id long, i long, x double, y double, z double")
    context = spark.sparkContext
    context.setJobGroup("steps", "steps")
    found = two_means(rows.repartition(3), ["x", "y", "z"], tolerance=0.0, starts=3, task_rows=1)
    jobs = len(context.statusTracker().getJobIdsForGroup("steps"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert [r.cluster for r in found.orderBy("i").collect()] == want.tolist()
    assert 2 * jobs < sum(end[2] for end in ends)


def test_both_ways_agree_on_whole_numbers_ties_and_missing_features(spark):
    rng = random.Random(9)
    rows = [(b, i, rng.randrange(-3, 4), 0.1 * rng.randrange(10)) for b in (0, 1, 2) for i in range(50)]
    rows += [(None, 60, None, 1.0), (1, 61, 2, float("nan")), (2, 62, 1, None), (3, 63, None, None), (4, 64, 5, 5.0)]
    rows += [(5, 70 + i, 1, 0.1) for i in range(30)]  # all the same
    table = spark.createDataFrame(rows, "batch_id long, i long, x int, y double")
    ways = [two_means(table.repartition(3), ["x", "y"], tolerance=0.0, starts=3, task_rows=n) for n in (1, 1000)]
    assert ways[0].schema.names == ways[1].schema.names
    one, other = (sorted(map(str, way.collect())) for way in ways)
    assert len(one) == len(rows) and one == other


def test_both_ways_agree_on_many_batches_and_few_steps(spark):
    rng = random.Random(3)
    rows = [(b, rng.gauss(b % 3, 1), rng.gauss(0, 2)) for b in range(70) for _ in range(12)]
    table = spark.createDataFrame(rows, "batch_id long, x double, y double").repartition(4)
    for options in ({}, {"steps": 2, "tolerance": -1.0}, {"steps": 0}):
        one, other = (sorted(map(tuple, two_means(table, ["x", "y"], task_rows=n, **options).collect())) for n in (1, 1000))
        assert one == other
