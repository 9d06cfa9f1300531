from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.functions import timerange as tr
from flowlens.operators import windows as win
from flowlens.operators.windows import SECOND, WindowGrid


def starts(grid):
    return [grid.anchor + k * grid.offset for k in range(grid.count)]


@settings(max_examples=200, deadline=None)
@given(
    anchor=st.integers(-50, 50), span=st.integers(0, 60), n=st.integers(-1, 30),
    offset=st.integers(1, 9), end=st.integers(-60, 120),
)
def test_lists_of_windows_follow_the_loop(anchor, span, n, offset, end):
    capture_end = span

    def loop(keep):
        found, at = [], anchor
        while keep(found, at):
            found.append(at)
            at += offset
        return found

    assert starts(win.windows_next(anchor, n, 3, offset, capture_end)) == loop(
        lambda f, at: len(f) < n and at <= capture_end
    )
    assert starts(win.windows_until(anchor, end, 3, offset, capture_end)) == loop(
        lambda f, at: at < end and at <= capture_end
    )
    assert starts(win.windows_in_period(anchor, end, 3, offset)) == loop(lambda f, at: at < end)
    assert win.n_remaining(anchor, 3, offset, capture_end) == len(
        loop(lambda f, at: at < capture_end and at <= capture_end)
    )


def test_cursor():
    grid = win.windows_next(100, 3, 30, 5, 1000)
    assert grid.next_anchor == win.skip_windows(100, 3, 5) == 115
    assert win.rewind_windows(grid.next_anchor, 3, 5) == 100
    # at the capture end the next window exists, but none remains
    assert win.windows_next(1000, 1, 30, 5, 1000).count == 1
    assert not win.has_more(1000, 30, 5, 1000)


@pytest.mark.parametrize("size,offset", [(30, 5), (6, 6), (4, 10), (7, 3), (1, 1)])
def test_assignment_follows_the_range_join(spark, size, offset):
    grid = WindowGrid(1_000_000, size * SECOND, offset * SECOND, 12)
    micros = [0, 999_999, 1_000_000, 1_000_001] + [1_000_000 + i * 700_001 for i in range(200)]
    micros += [1_000_000 + k * offset * SECOND for k in range(14)]
    micros += [1_000_000 + k * offset * SECOND + size * SECOND for k in range(14)]
    rows = spark.createDataFrame([(m,) for m in micros], "m long").select(
        "m", F.timestamp_micros("m").alias("parsed_time")
    )
    found = sorted((r.m, r.window_index) for r in win.assign_windows(rows, grid).collect())
    expected = sorted(
        (m, k) for m in micros for k in range(12)
        if 1_000_000 + k * offset * SECOND <= m < 1_000_000 + (k * offset + size) * SECOND
    )
    assert found == expected


def test_tumbling_equals_builtin_window(spark):
    rows = spark.range(500).select(F.timestamp_micros(F.col("id") * 1_234_567).alias("parsed_time"))
    grid = WindowGrid(0, 10 * SECOND, 10 * SECOND, 100)
    ours = win.window_times(win.assign_windows(rows, grid), grid).groupBy("window_start").count()
    theirs = rows.groupBy(F.window("parsed_time", "10 seconds").start.alias("window_start")).count()
    assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()


def test_batches_keep_empty_ones_and_report_the_later_start(spark):
    seconds = [0, 1, 2, 20, 21]
    rows = spark.createDataFrame([(s,) for s in seconds], "s int").select(
        F.timestamp_seconds("s").alias("window_start")
    )
    found = win.batch_counts(rows, "window_start", 5 * SECOND, 4 * SECOND).orderBy("batch_id").collect()
    expected, low = [], 0
    while low <= 21 - 5 + 4:
        expected.append((low, low + 4, low + 5, sum(low <= s < low + 5 for s in seconds)))
        low += 4
    got = [
        tuple(tr.to_micros(r[c]) // SECOND for c in ("lower_bound", "batch_start", "batch_end")) + (r.n_rows,)
        for r in found
    ]
    assert got == expected
    assert 0 in [n for *_, n in expected]
    assert win.batch_counts(rows, "window_start", 5 * SECOND, 4 * SECOND, min_rows=2).count() == sum(
        n >= 2 for *_, n in expected
    )


def test_time_range_without_bounds_is_the_input(spark):
    rows = spark.range(3).select(F.timestamp_seconds("id").alias("parsed_time"))
    assert tr.in_time_range(rows).count() == 3
    assert tr.in_time_range(rows, datetime(1970, 1, 1, 0, 0, 1), include_lower=False).count() == 1


def test_iso_text(spark):
    rows = spark.createDataFrame([(0,), (1_500_000,)], "m long").select(F.timestamp_micros("m").alias("t"))
    texts = [r[0] for r in rows.select(tr.iso_string(F.col("t"))).collect()]
    assert texts == [datetime(1970, 1, 1).isoformat(), datetime(1970, 1, 1, 0, 0, 1, 500000).isoformat()]
