"""The feature table of a stream, graph metrics included, as a ``foreachBatch`` sink."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timerange import instant, micros_of
from flowlens.operators.graph import graph_metrics
from flowlens.operators.stats import pane_stats, window_stats
from flowlens.operators.windows import SECOND, WindowGrid, window_times
from flowlens.plans.features import fill_missing
from flowlens.schema import feature_schema
from flowlens.streaming.stats import STREAM_BLOCK, _duration, _late_after, stream_slot, stream_slot_stats
from flowlens.streaming.versions import RANGE, VersionedRows, latest, write_row

STATE = (
    "version long, ended boolean, next_window long, closed_pane long, "
    f"held array<struct<{RANGE.replace(' bigint', ':bigint')}>>"
)
SLOT, EDGE = 0, 1


@dataclass(frozen=True)
class FeatureSink:
    """Features of the windows of a grid, as soon as the watermark has passed them.

    ``sink.parts(packets)`` is the stream to write with ``foreachBatch(sink)``: slot summaries and
    edges counted per pane, each put out once when it has closed. The sink keeps them in a store
    with a version per micro-batch, merges the panes of windows that have closed since, and runs
    the same statistics and graph metrics as in batch on them. Overlapping windows share their
    panes, and a micro-batch reads the versions that its windows reach. One that is run again
    after a failure finds its version and writes nothing.
    """

    folder: str
    grid: WindowGrid
    delay: str
    slot: int = 60 * SECOND
    block: int = STREAM_BLOCK

    def parts(self, packets: DataFrame) -> DataFrame:
        """Closed slots and closed panes' edges of a packet stream, in one table."""
        grid = self.grid
        slots = stream_slot_stats(packets, grid, self.delay, self.slot, self.block)
        pane, start = _duration(grid.pane), _duration(grid.anchor % grid.pane)
        counted = (
            _late_after(packets, self.delay).where(F.col("parsed_time") >= instant(F.lit(grid.anchor)))
            .groupBy(F.window("parsed_time", pane, pane, start).alias("w"), "Source", "Destination")
            .agg(F.count("*").alias("count"))
        )
        number = F.call_function("div", micros_of("w.start") - grid.anchor, F.lit(grid.pane))
        edges = counted.select(F.lit(EDGE).alias("kind"), number.alias("pane"), "Source", "Destination", "count")
        return slots.withColumn("kind", F.lit(SLOT)).unionByName(edges, allowMissingColumns=True)

    def __call__(self, rows: DataFrame, micro_batch: int) -> None:
        spark = rows.sparkSession
        state = latest(spark, STATE, f"{self.folder}/state")
        if state is not None and state.version >= micro_batch:
            return
        done, closed, ranges = (state.next_window, state.closed_pane, state.held) if state else (0, -1, [])
        store = VersionedRows(f"{self.folder}/parts")
        mine = store.write(rows, micro_batch, F.col("pane"))
        if mine:
            newest = store.read(spark, rows.schema, mine, mine[0][1]).where(f"kind = {EDGE}").agg(F.max("pane")).first()[0]
            closed = closed if newest is None else max(closed, newest)
        ranges = [*ranges, *mine]
        # panes before the newest closed one are closed, and their slots have all been put out
        ready = (closed * self.grid.pane - self.grid.size) // self.grid.offset + 1
        ready = max(min(ready, self.grid.count), done)
        low = done * self.grid.offset // self.grid.pane
        if ready > done:
            made = self._features(store.read(spark, rows.schema, ranges, low), done, ready)
            made.write.mode("overwrite").parquet(f"{self.folder}/features/version={micro_batch}")
        held = VersionedRows.still_needed(ranges, ready * self.grid.offset // self.grid.pane)
        write_row(spark, (micro_batch, False, ready, closed, held), STATE, f"{self.folder}/state/v{micro_batch}")

    def features(self, spark: SparkSession) -> DataFrame:
        """Feature rows of all windows that have closed so far."""
        empty = spark.createDataFrame([], feature_schema())
        state = latest(spark, STATE, f"{self.folder}/state")
        if state is None or not state.next_window:
            return empty
        return spark.read.schema(feature_schema()).parquet(f"{self.folder}/features/version=*")

    def _features(self, parts: DataFrame, done: int, ready: int) -> DataFrame:
        """The windows from number ``done`` up to ``ready``, numbered as in the whole grid."""
        grid, shift = self.grid, done * self.grid.offset
        part = WindowGrid(grid.anchor + shift, grid.size, grid.offset, ready - done)
        slot, panes = stream_slot(grid, self.slot), shift // grid.pane
        inside = parts.where(f"pane >= {panes} AND pane < {panes + (part.end - part.anchor) // grid.pane}")
        moved = inside.withColumns({
            "pane": F.col("pane") - panes, "first": F.col("first") - shift, "last": F.col("last") - shift,
        })
        stats = fill_missing(window_stats(pane_stats(moved.where(f"kind = {SLOT}"), part, slot), part))
        edges = (
            moved.where(f"kind = {EDGE}")
            .select(F.explode(part.windows_at(f"pane * {grid.pane}")).alias("window_index"), "Source", "Destination", "count")
            .groupBy("window_index", "Source", "Destination").agg(F.sum("count").alias("count"))
        )
        rows = window_times(stats.join(graph_metrics(edges), ["window_index", "IP"], "left"), part)
        return rows.withColumn("window_index", F.col("window_index") + done).select(*feature_schema().names)
