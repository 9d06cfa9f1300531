import random

import brute
import pytest

from flowlens.operators import graph


def edge_table(spark, windows):
    rows = [(k, a, b) for k, edges in windows.items() for a, b in edges]
    return spark.createDataFrame(rows, "window_index long, Source string, Destination string")


def random_windows(seed, windows=3, n=9, density=0.22):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    return {
        k: sorted({(a, b) for a in names for b in names if rng.random() < density} | {("n0", "n1")})
        for k in range(windows)
    }


FIXED = {
    0: [("A", "B"), ("B", "C")],
    1: [("A", "B"), ("B", "C"), ("C", "A")],
    2: [("A", "A"), ("A", "B")],
    3: [("A", "A")],
    4: [("hub", f"x{i}") for i in range(12)] + [(f"x{i}", "hub") for i in range(0, 12, 2)],
}


def check(found, windows):
    rows = {(r["window_index"], r["IP"]): r for r in found.collect()}
    for k, edges in windows.items():
        between, eigen = brute.betweenness(edges), brute.eigenvector(edges)
        for ip in between:
            row = rows.pop((k, ip))
            assert row["centrality"] == pytest.approx(between[ip], abs=1e-12)
            assert row["eigenvector_centrality"] == pytest.approx(eigen[ip], abs=1e-9)
            assert row["in_degree"] == sum(b == ip for _, b in edges)
            assert row["out_degree"] == sum(a == ip for a, _ in edges)
    assert not rows


def test_fixed_graphs(spark):
    found = graph.graph_metrics(edge_table(spark, FIXED))
    check(found, FIXED)
    row = {(r["window_index"], r["IP"]): r for r in found.collect()}[1, "A"]
    assert row["eigenvector_centrality"] == pytest.approx(0.57735027, abs=1e-8)
    assert row["centrality"] == 0.5


def test_random_graphs_and_spread_over_tasks(spark):
    windows = random_windows(3, windows=6, n=14)
    edges = edge_table(spark, windows)
    check(graph.graph_metrics(edges), windows)
    check(graph.graph_metrics(edges, task_pairs=500), windows)


def test_large_windows_by_joins_are_exact(spark):
    """Windows beyond a task, next to small ones; busy senders split, sources in two blocks."""
    windows = {0: [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("A", "D"), ("D", "E"), ("D", "A")], 1: FIXED[1][:2]}
    found = graph.graph_metrics(edge_table(spark, windows), task_edges=3, per_salt=1, state_rows=13, steps=100)
    check(found, windows)


def test_large_window_that_does_not_settle_is_zero(spark):
    windows = {0: FIXED[0]}
    found = graph.eigenvector(edge_table(spark, windows), task_edges=1, steps=3)
    assert {r["eigenvector_centrality"] for r in found.collect()} == {0.0}
