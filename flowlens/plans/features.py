"""The feature table: packet statistics and graph metrics per window and address."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from flowlens.functions.labels import label_bots
from flowlens.functions.timerange import to_micros
from flowlens.operators import windows as win
from flowlens.operators.graph import graph_metrics
from flowlens.operators.stats import edges, packet_stats
from flowlens.operators.windows import SECOND, WindowGrid, window_times
from flowlens.schema import DESTINATION_METRICS, FEATURES, META_COLUMNS, SOURCE_METRICS, feature_schema
from flowlens.sources.feature_table import FeatureKey, read_or_compute
from flowlens.sources.packets import complete_packets, read_packets_csv


def fill_missing(stats: DataFrame) -> DataFrame:
    """Zero for every metric of a side that did not occur, and for spreads of a single packet."""
    kinds = {field.name: field.dataType for field in feature_schema().fields}
    return stats.selectExpr(
        "window_index", "IP",
        *[f"CAST(coalesce({name}, 0) AS {kinds[name].simpleString()}) AS {name}"
          for name in SOURCE_METRICS + DESTINATION_METRICS],
    )


def calculate_metrics(packets: DataFrame, grid: WindowGrid, **graph_options) -> DataFrame:
    """Features of all windows of a grid in one plan.

    Statistics and graph cover the same addresses, so the outer join of the two is a left
    join here. Both sides are grouped by (window, address) already.
    """
    stats = fill_missing(packet_stats(packets, grid))
    graph = graph_metrics(edges(packets, grid), **graph_options)
    return stats.join(graph, ["window_index", "IP"], "left")


def features(packets: DataFrame, grid: WindowGrid, **graph_options) -> DataFrame:
    """Feature rows with their window; windows without packets give no rows."""
    spark = packets.sparkSession
    if grid.count == 0:
        return spark.createDataFrame([], feature_schema())
    metrics = window_times(calculate_metrics(packets, grid, **graph_options), grid)
    return metrics.select(*feature_schema().names)


@dataclass(frozen=True)
class Capture:
    """A packet table with window geometry and bounds. Anchors are passed in, never stored."""

    packets: DataFrame
    size: int
    offset: int
    start: int
    end: int

    @classmethod
    def open(cls, packets: DataFrame, window_seconds: float, offset_seconds: float) -> Capture:
        """Reads the bounds of the capture, from the time column alone."""
        bounds = win.read_bounds(packets)
        if bounds is None:
            raise ValueError("the capture holds no packet with a time")
        size, offset = int(window_seconds * SECOND), int(offset_seconds * SECOND)
        return cls(complete_packets(packets), size, offset, *bounds)

    def _anchor(self, anchor: datetime | int | None) -> int:
        return self.start if anchor is None else to_micros(anchor)

    def skip(self, n: int, anchor: datetime | int | None = None) -> int:
        return win.skip_windows(self._anchor(anchor), n, self.offset)

    def rewind(self, n: int, anchor: datetime | int | None = None) -> int:
        return win.rewind_windows(self._anchor(anchor), n, self.offset)

    def windows_next(self, n: int, anchor: datetime | int | None = None) -> WindowGrid:
        return win.windows_next(self._anchor(anchor), n, self.size, self.offset, self.end)

    def windows_until(self, end: datetime | int, anchor: datetime | int | None = None) -> WindowGrid:
        return win.windows_until(self._anchor(anchor), end, self.size, self.offset, self.end)

    def windows_in_period(self, start: datetime | int, end: datetime | int) -> WindowGrid:
        return win.windows_in_period(start, end, self.size, self.offset)

    def n_remaining(self, anchor: datetime | int | None = None) -> int:
        return win.n_remaining(self._anchor(anchor), self.size, self.offset, self.end)

    def has_more(self, anchor: datetime | int | None = None) -> bool:
        return self.n_remaining(anchor) > 0

    def next_samples(self, n: int = 1, anchor: datetime | int | None = None) -> DataFrame:
        return features(self.packets, self.windows_next(n, anchor))

    def samples_until(self, end: datetime | int, anchor: datetime | int | None = None) -> DataFrame:
        return features(self.packets, self.windows_until(end, anchor))

    def samples_in_period(self, start: datetime | int, end: datetime | int) -> DataFrame:
        return features(self.packets, self.windows_in_period(start, end))

    def remaining_samples(self, anchor: datetime | int | None = None) -> DataFrame:
        return self.samples_until(self.end, anchor)

    def all_samples(self) -> DataFrame:
        return self.samples_in_period(self.start, self.end)


def feature_columns(rows: DataFrame) -> DataFrame:
    """The numeric feature columns alone, as a model takes them."""
    return rows.drop(*META_COLUMNS).select(*[c for c in FEATURES if c in rows.columns])


def labelled_features(
    packets: DataFrame, bots: Sequence[str] | DataFrame, start: datetime | int, end: datetime | int,
    window_seconds: float, offset_seconds: float,
) -> DataFrame:
    """Features of the windows from ``start`` up to ``end``, with the bot label."""
    capture = Capture.open(packets, window_seconds, offset_seconds)
    return label_bots(capture.samples_until(end, start), bots)


def stored_features(
    spark: SparkSession, dataset: str, bots: Sequence[str] | DataFrame, start: datetime, end: datetime,
    window_seconds: int, offset_seconds: int, root: str,
) -> DataFrame:
    """Labelled features of a capture file; the unlabelled table is stored and used again."""
    key = FeatureKey(dataset, window_seconds, offset_seconds, start, end)

    def compute() -> DataFrame:
        packets = read_packets_csv(spark, dataset)
        return Capture.open(packets, window_seconds, offset_seconds).samples_until(end, start)

    return label_bots(read_or_compute(spark, root, key, compute), bots)
