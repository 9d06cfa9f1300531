import random

import brute
import pytest
from pyspark.sql import functions as F

from flowlens.operators import stats
from flowlens.operators.windows import SECOND, WindowGrid

NAMES = {
    "Source": ["Spc", "Tss", "Smin", "Smax", "Savg", "Svar", "SITmin", "SITmax", "SITavg", "SITvar"],
    "Destination": ["Rpc", "Tsr", None, None, "Ravg", "Rvar", "RITmin", "RITmax", "RITavg", "RITvar"],
}


def table(spark, packets):
    return spark.createDataFrame(packets, "Source string, Destination string, us long, frame_len int").select(
        "Source", "Destination", F.timestamp_micros("us").alias("parsed_time"), "frame_len"
    )


def traffic(seed, n=600, ties=True):
    """One address sends a third of all packets, many of them at the same instants."""
    rng = random.Random(seed)
    hosts = [f"h{i}" for i in range(8)]
    out = []
    for _ in range(n):
        hot = rng.random() < 1 / 3
        us = rng.randrange(60) * 1_000_003 if ties and rng.random() < 0.5 else rng.randrange(60 * SECOND)
        out.append(("bot" if hot else rng.choice(hosts), rng.choice(hosts), us, rng.randrange(40, 1500)))
    return out


def assert_equal(found, expected):
    rows = {(r["window_index"], r["IP"]): r for r in found.collect()}
    assert set(rows) == set(expected)
    for key, roles in expected.items():
        for role, names in NAMES.items():
            values = roles.get(role, (None,) * 10)
            for name, value in zip(names, values):
                if name:
                    got = rows[key][name]
                    assert got == pytest.approx(value, abs=1e-9) if value is not None else got is None, (key, name)


@pytest.mark.parametrize(
    "size,offset,slot", [(30, 5, 60), (30, 5, 1), (7, 3, 0.4), (10, 10, 3), (4, 9, 1), (6, 2.5, 60)]
)
def test_statistics_follow_the_window_scan(spark, size, offset, slot):
    packets = traffic(int(size * 10 + offset))
    size, offset, slot = (int(x * SECOND) for x in (size, offset, slot))
    grid = WindowGrid(1_500_000, size, offset, 9)
    starts = [grid.anchor + k * offset for k in range(9)]
    found = stats.packet_stats(table(spark, packets), grid, slot=slot)
    assert_equal(found, brute.packet_stats(packets, starts, size))


def test_many_slots_are_ordered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAX_SLOTS", 3)
    packets = traffic(77)
    grid = WindowGrid(500_000, 9 * SECOND, 2 * SECOND, 20)
    starts = [grid.anchor + k * grid.offset for k in range(20)]
    found = stats.packet_stats(table(spark, packets), grid)
    assert "block" in found._jdf.queryExecution().toString()
    assert_equal(found, brute.packet_stats(packets, starts, grid.size))


def test_steady_gaps_have_no_spread(spark):
    """A beacon: large equal gaps would lose a spread computed from floating sums."""
    packets = [("bot", "c2", 3_600_000_001 * i, 100) for i in range(50)] + [("bot", "c2", 3_600_000_001 * 50 + 1, 100)]
    grid = WindowGrid(0, 200_000 * SECOND, 200_000 * SECOND, 1)
    row = stats.source_metrics(table(spark, packets), grid).first()
    assert row["SITvar"] == pytest.approx(brute.spread([3600.000001] * 49 + [3600.000002]), rel=1e-6)
    assert row["Svar"] == 0.0


def test_time_diff_follows_the_window_scan(spark):
    packets = traffic(5, ties=False)
    grid = WindowGrid(0, 10 * SECOND, 4 * SECOND, 12)
    for role, column in (("Source", 0), ("Destination", 1)):
        seen = stats.window_time_diff(table(spark, packets), grid, role)
        found = sorted(
            (r["window_index"], r[role], -1.0 if r[f"{role}_time_diff"] is None else r[f"{role}_time_diff"])
            for r in seen.collect()
        )
        expected = []
        for k in range(12):
            last = {}
            for p in sorted((p for p in packets if k * 4 <= p[2] / SECOND < k * 4 + 10), key=lambda p: p[2]):
                before = last.get(p[column])
                expected.append((k, p[column], -1.0 if before is None else (p[2] - before) / 1e6))
                last[p[column]] = p[2]
        assert found == sorted(expected)


def test_edges_and_sums_agree(spark):
    packets = traffic(9)
    grid = WindowGrid(0, 12 * SECOND, 4 * SECOND, 15)
    data = table(spark, packets)
    edges = stats.edges(data, grid)
    sums = stats.packet_stats(data, grid).groupBy("window_index").agg(
        F.sum("Spc").alias("sent"), F.sum("Rpc").alias("received")
    )
    counts = edges.groupBy("window_index").agg(F.sum("count").alias("n"))
    joined = sums.join(counts, "window_index", "full")
    assert joined.filter("sent <> n OR received <> n OR n IS NULL OR sent IS NULL").isEmpty()
    expected = {}
    for k in range(15):
        for s, d, us, _ in packets:
            if k * 4 * SECOND <= us < (k * 4 + 12) * SECOND:
                expected[k, s, d] = expected.get((k, s, d), 0) + 1
    assert {(r[0], r[1], r[2]): r[3] for r in edges.collect()} == expected


def test_hot_address_is_not_one_task(spark):
    """The ordered step is keyed by slot, and equal times are merged before it."""
    grid = WindowGrid(0, 30 * SECOND, 5 * SECOND, 10)
    plan = stats.packet_stats(table(spark, traffic(1)), grid)._jdf.queryExecution().toString()
    assert "lag(rel" in plan
    for line in plan.splitlines():
        if "windowspecdefinition" in line and "lag(rel" in line:
            assert "slot" in line.split("windowspecdefinition")[1].split("specifiedwindowframe")[0]


def test_missing_lengths_play_no_part_in_sizes(spark):
    rows = [("a", "b", 1, 100), ("a", "b", 2, None), ("a", "b", 3, 200), ("c", "b", 3, None), ("c", "b", 3, None)]
    packets = spark.createDataFrame(rows, "Source string, Destination string, s long, frame_len int").select(
        "Source", "Destination", F.timestamp_seconds("s").alias("parsed_time"), "frame_len"
    )
    found = {r.IP: r for r in stats.packet_stats(packets, WindowGrid(0, 10 * SECOND, 10 * SECOND, 1)).collect()}
    a, b, c = found["a"], found["b"], found["c"]
    assert (a.Spc, a.Tss, a.Smin, a.Smax, a.Savg) == (3, 300, 100, 200, 150.0) and round(a.Svar, 6) == 70.710678
    assert (b.Rpc, b.Tsr, b.Ravg) == (5, 300, 150.0)
    assert (c.Spc, c.Tss, c.Smin, c.Savg, c.Svar, c.SITmax) == (2, None, None, None, None, 0.0)
