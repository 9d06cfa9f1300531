"""Near-duplicate operators and searches against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import jaccard_join
from flowlens.llm.ann import nearest_neighbours
from flowlens.llm.components import connected_components
from flowlens.llm.embedding_dedup import near_duplicate_vectors, plan_tables
from flowlens.llm.jaccard_join import DivideSkip, jaccard_components, overlap_reached


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (8, 5), (20, 21), (7, 7), (None, 3), (20, 21)]
    got = connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    want = smallest_reachable([3, 4, 5, 8, 9, 20, 21], [(5, 4), (4, 3), (9, 8), (8, 5), (20, 21)])
    assert {(r.node, r.component) for r in got} == set(want.items())
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near_copies():
    """Groups of copies of many sizes, a passage that many share, odd texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows, n = [], 0
    for size, length in [(1, 40), (3, 80), (12, 120), (130, 60), (2, 5), (5, 9)]:
        base = [word() for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(length)] = word()
            rows.append((n, " ".join(words)))
            n += 1
    for _ in range(90):
        own = [word() for _ in range(rng.choice([8, 20, 60]))]
        rows.append((n, " ".join(own + passage if rng.random() < 0.5 else passage + own)))
        n += 1
    odd = [None, "", " \t\n", "one", "One", "two words", "É x", "é x", "a\x0bb c d e", "A B C D E", "x" * 5000, "x" * 5000]
    rows += [(n + i, t) for i, t in enumerate(odd)]
    return rows


def most_frequent(rows):
    counted = rows.select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count > 20")
    return np.sort(np.array([r.gram for r in counted.collect()], np.int64))


@pytest.mark.parametrize(("width", "percent", "often"), [(4, 85, None), (5, 80, 1)])
def test_jaccard_against_all_pairs(spark, monkeypatch, width, percent, often):
    if often:  # shingles count as hot from a few documents on
        monkeypatch.setattr(jaccard_join, "hot_shingles", lambda rows, total: most_frequent(rows))
    rows = near_copies()
    sets = {i: shingles(t, width) for i, t in rows}
    links = []
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    want = {i: (len(sets[i]), c) for i, c in smallest_reachable(sets, links).items()}
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, gram string")
    got = jaccard_components(docs.repartition(5), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows) and len({c for _, c in want.values()}) < len(rows)


def test_jaccard_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (1, "A b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(docs).collect()) == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(10_000, 60, replace=False))
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 10_000, 60), base)) for _ in range(80)]
    index, all_of = DivideSkip(sets), np.ones(80, bool)
    for query in sets[:20]:
        want = [i for i, s in enumerate(sets) if overlap_reached(query, s, 80)]
        assert sorted(index.search(query, 80, all_of).tolist()) == want


def vectors(seed=3, n=300, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[50:140] = x[50] + 0.08 * rng.normal(size=(90, dim))
    x[200:205] = x[199]
    x[210:214] = x[209] + 0.3 * rng.normal(size=(4, dim))
    return x.astype(np.float32)


ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1),
       (905, [float("inf")] + [1.0] * 15, 1), (906, [1.0] * 3, 1), (907, [1.0] * 16, None), (908, [1.0] * 16, None)]


def test_embedding_links_against_all_pairs(spark):
    x = vectors()
    label = np.arange(len(x)) // 150
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    parts = smallest_reachable(range(len(x)), np.argwhere(linked).tolist())
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))] + ODD
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("dim", F.lit("clash"))
    got = {r.vec_id: r for r in near_duplicate_vectors(table).collect()}
    assert len(got) == len(rows) and linked.sum() > 5000
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), parts[i], parts[i] == i)
    for i, *_ in ODD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert near_duplicate_vectors(table.limit(0)).count() == 0


def test_tables_keep_the_chance_of_a_miss():
    for rows in (10, 10_000, 10_000_000):
        bits, tables = plan_tables(rows, 0.93, 1e-4)
        alike = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - alike) ** tables <= 1e-4


def test_nearest_neighbours(spark):
    x = vectors(n=400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, v) for i, v, _ in ODD[:7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1))
    got = nearest_neighbours(table, F.col("vec_id") % 20 == 0, k=10).collect()
    scores = x.astype(float) @ x.astype(float).T
    found = 0
    for q in range(0, 400, 20):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - scores[q, r.vec_id]) < 1e-9 and r.vec_id != q for r in mine)
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[q, i], i))[:10]
        found += len(set(best) & {r.vec_id for r in mine})
    assert found >= 0.9 * 200
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = nearest_neighbours(table.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_nearest_neighbours_of_repeated_ids_and_mixed_lengths(spark):
    x = vectors(n=300).astype(float)
    x[7] *= 20  # one vector far longer than the rest: its length sets the width of the cells
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(41, x[41].tolist())] * 60 + [(1000, (x[0] * 1e-6).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(table, F.col("vec_id") % 20 == 0, k=20).collect()
    for q in [*range(0, 300, 20), 1000]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and len({r.vec_id for r in mine}) == 20
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
    # cells so narrow that no query finds enough: all are compared with all rows
    exact = nearest_neighbours(table, F.col("vec_id") % 20 == 0, k=20, width=1e-4, probes=1).collect()
    ids = [*range(300), 1000]
    v = np.vstack([x, x[:1] * 1e-6])
    for n, q in enumerate(ids):
        if q % 20 == 0:
            scores = (v[n] * v).sum(axis=1)
            best = sorted((m for m in range(len(ids)) if m != n), key=lambda m: (-scores[m], ids[m]))[:20]
            assert [r.vec_id for r in sorted((r for r in exact if r.query_id == q), key=lambda r: r.rank)] == [ids[m] for m in best]
