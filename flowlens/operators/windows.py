"""Sliding windows anchored at a chosen instant, as arithmetic on integer microseconds.

A list of windows is a :class:`WindowGrid` of four numbers. Rows find their windows by
division, so no range join is needed and every step is a narrow projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timerange import instant, micros_sql, to_micros

SECOND = 1_000_000


@dataclass(frozen=True)
class WindowGrid:
    """``count`` half-open windows ``[anchor + k*offset, anchor + k*offset + size)``, in microseconds."""

    anchor: int
    size: int
    offset: int
    count: int

    @property
    def end(self) -> int:
        """End of the last window."""
        return self.anchor + max(self.count - 1, 0) * self.offset + (self.size if self.count else 0)

    @property
    def next_anchor(self) -> int:
        """Where the window after the last one starts."""
        return self.anchor + self.count * self.offset

    @property
    def pane(self) -> int:
        """Widest slice of time that never straddles a window border."""
        return gcd(self.size, self.offset)

    def start_of(self, index: Column) -> Column:
        return index * self.offset + self.anchor

    def windows_at(self, position: str) -> Column:
        """Indexes of the windows that hold a position: an SQL text in microseconds after the anchor.

        Null when there is none, because a descending sequence would count backwards.
        """
        low = f"greatest(0L, {floor_div(f'({position} - {self.size})', self.offset)} + 1)"
        high = f"least({self.count - 1}L, {floor_div(f'({position})', self.offset)})"
        return F.expr(f"CASE WHEN {high} >= {low} THEN sequence({low}, {high}) END")


def floor_div(value: str, step: int) -> str:
    """Integer floor division as SQL text; ``div`` truncates, so the remainder is taken out first."""
    return f"(({value} - pmod({value}, {step}L)) div {step}L)"


# --- capture bounds and the cursor -------------------------------------------------------


def capture_bounds(packets: DataFrame, on: str = "parsed_time") -> DataFrame:
    """First and last time of a capture, as one row."""
    return packets.agg(F.min(on).alias("capture_start"), F.max(on).alias("capture_end"))


def read_bounds(packets: DataFrame, on: str = "parsed_time") -> tuple[int, int] | None:
    """The capture bounds in microseconds; ``None`` for a capture without packets."""
    row = packets.selectExpr(f"min({micros_sql(on)})", f"max({micros_sql(on)})").first()
    return None if row[0] is None else (row[0], row[1])


def skip_windows(anchor: int, n: int, offset: int) -> int:
    """The anchor ``n`` windows further on."""
    return anchor + n * offset


def rewind_windows(anchor: int, n: int, offset: int) -> int:
    """The anchor ``n`` windows back."""
    return anchor - n * offset


# --- lists of windows --------------------------------------------------------------------


def _starts_up_to(anchor: int, last: int, offset: int) -> int:
    """Number of window starts from the anchor to ``last``, both included."""
    return max((last - anchor) // offset + 1, 0)


def _starts_before(anchor: int, end: int, offset: int) -> int:
    """Number of window starts from the anchor to ``end``, ``end`` excluded."""
    return max(-((anchor - end) // offset), 0)


def windows_next(anchor: int, n: int, size: int, offset: int, capture_end: int) -> WindowGrid:
    """The next ``n`` windows, as long as a window starts no later than the capture end."""
    return WindowGrid(anchor, size, offset, max(min(n, _starts_up_to(anchor, capture_end, offset)), 0))


def windows_until(
    anchor: int, end: datetime | int, size: int, offset: int, capture_end: int
) -> WindowGrid:
    """Windows that start before ``end`` and no later than the capture end."""
    count = min(_starts_before(anchor, to_micros(end), offset), _starts_up_to(anchor, capture_end, offset))
    return WindowGrid(anchor, size, offset, count)


def windows_in_period(start: datetime | int, end: datetime | int, size: int, offset: int) -> WindowGrid:
    """Windows from ``start`` on that start before ``end``, whatever the capture holds."""
    first = to_micros(start)
    return WindowGrid(first, size, offset, _starts_before(first, to_micros(end), offset))


def n_remaining(anchor: int, size: int, offset: int, capture_end: int) -> int:
    """How many windows start before the capture end."""
    return windows_until(anchor, capture_end, size, offset, capture_end).count


def has_more(anchor: int, size: int, offset: int, capture_end: int) -> bool:
    return n_remaining(anchor, size, offset, capture_end) > 0


def window_table(spark: SparkSession, grid: WindowGrid) -> DataFrame:
    """All windows of a grid as rows, also those that hold no packet."""
    return window_times(spark.range(grid.count).select(F.col("id").alias("window_index")), grid)


def window_times(df: DataFrame, grid: WindowGrid) -> DataFrame:
    """Add ``window_start`` and ``window_end`` to rows that carry a ``window_index``."""
    start = grid.start_of(F.col("window_index"))
    return df.withColumns(
        {"window_start": instant(start), "window_end": instant(start + grid.size)}
    )


# --- rows to windows ---------------------------------------------------------------------


def assign_windows(df: DataFrame, grid: WindowGrid, on: str = "parsed_time") -> DataFrame:
    """Each row once for every window that holds it, with ``window_index``."""
    position = f"{micros_sql(on)} - {grid.anchor}"
    return df.select("*", F.explode(grid.windows_at(position)).alias("window_index"))


def batch_grid(rows: DataFrame, on: str, size: int, offset: int) -> WindowGrid:
    """Batches over feature rows: the first starts at the first row, the last no later than
    the last row minus ``size`` plus ``offset``."""
    bounds = read_bounds(rows, on)
    if bounds is None:
        return WindowGrid(0, size, offset, 0)
    first, last = bounds
    return WindowGrid(first, size, offset, _starts_up_to(first, last - size + offset, offset))


def batch_table(spark: SparkSession, grid: WindowGrid) -> DataFrame:
    """All batches, also empty ones.

    ``lower_bound`` is where a batch begins. ``batch_start`` is one offset later: that is the
    start a batch has always been reported with, and the run statistics keep it.
    """
    lower = grid.start_of(F.col("id"))
    return spark.range(grid.count).select(
        F.col("id").alias("batch_id"),
        instant(lower).alias("lower_bound"),
        instant(lower + grid.offset).alias("batch_start"),
        instant(lower + grid.size).alias("batch_end"),
    )


def assign_batches(rows: DataFrame, grid: WindowGrid, on: str) -> DataFrame:
    """Each feature row once for every batch that holds it, with ``batch_id``."""
    position = f"{micros_sql(on)} - {grid.anchor}"
    return rows.select("*", F.explode(grid.windows_at(position)).alias("batch_id"))


def batch_counts(rows: DataFrame, on: str, size: int, offset: int, min_rows: int = 0) -> DataFrame:
    """Rows per batch, empty batches included; ``min_rows`` leaves out the smaller ones."""
    grid = batch_grid(rows, on, size, offset)
    counts = assign_batches(rows.select(on), grid, on).groupBy("batch_id").agg(F.count("*").alias("n_rows"))
    counted = batch_table(rows.sparkSession, grid).join(counts, "batch_id", "left").withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0).cast("long"))
    )
    return counted.filter(F.col("n_rows") >= min_rows) if min_rows else counted
