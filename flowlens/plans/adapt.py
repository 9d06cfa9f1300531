"""The adaptive loop: watch batches of features, and refit the classifier when they change.

Work goes in rounds of several batches. One round compares all its batches with the
reference in one job; only six numbers per batch come back, to be fed to the detectors.
A round ends early at the first change, which starts a new epoch: the batch becomes the
reference, the classifier is chosen anew on it, and the detectors start afresh.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.agreement import Metric
from flowlens.functions.durable import checkpoint_folder, durable
from flowlens.functions.timerange import in_time_range, instant
from flowlens.operators.detectors import DETECTORS, Detector, fresh
from flowlens.operators.windows import SECOND, WindowGrid, assign_batches, batch_grid
from flowlens.plans.ensemble import batch_metrics
from flowlens.plans.models import Selection, accuracy, select_model
from flowlens.schema import FEATURES

ROUND = 20
ON = "window_start"
STATISTICS = "batch_id long, drift_detection int, batch_start timestamp, batch_end timestamp, accuracy double"


@dataclass
class Watch:
    """Detectors of the current epoch, one panel per (classifier, metric)."""

    panel: Mapping[str, Callable[[], Detector]] = field(default_factory=lambda: DETECTORS)
    series: dict[str, dict[str, Detector]] = field(default_factory=dict)

    def feed(self, values: Mapping[str, float | None]) -> bool:
        """Metric values of one batch; true when any detector of any metric signals a change."""
        signals = []
        for name, value in sorted(values.items()):
            detectors = self.series.setdefault(name, fresh(self.panel))
            if value is not None:
                signals += [one.add(float(value)) for one in detectors.values()]
        return any(signals)

    def dump(self) -> str:
        return json.dumps({s: {n: d.dump() for n, d in panel.items()} for s, panel in self.series.items()})

    def load(self, state: str) -> Watch:
        for name, panel in json.loads(state).items():
            made = fresh(self.panel)
            self.series[name] = {n: made[n].load(d) for n, d in panel.items()}
        return self


@dataclass
class Epoch:
    """One reference, one model, one set of detectors, and the next batch to look at."""

    reference: DataFrame
    model: Selection
    watch: Watch
    next_batch: int = 0


@dataclass(frozen=True)
class Adaptive:
    """Settings of the loop. ``select`` picks a model from labelled rows."""

    batch_seconds: float = 60
    offset_seconds: float = 1
    columns: Sequence[str] = tuple(FEATURES)
    panel: Mapping[str, Callable[[], Detector]] = field(default_factory=lambda: DETECTORS)
    select: Callable[[DataFrame], Selection] = select_model
    round_size: int = ROUND
    least_rows: int = 2
    score_before_refit: bool = False
    scaled: bool = False
    metrics: Mapping[str, Metric] | None = None

    def begin(self, train: DataFrame) -> Epoch:
        """Choose the first model and take the training rows as the first reference."""
        kept = durable(train)
        return Epoch(kept, self.select(kept), Watch(self.panel))

    def grid(self, rows: DataFrame) -> WindowGrid:
        return batch_grid(rows, ON, int(self.batch_seconds * SECOND), int(self.offset_seconds * SECOND))

    def advance(
        self, epoch: Epoch, rows: DataFrame, grid: WindowGrid, emit: Callable[[DataFrame], None]
    ) -> Epoch:
        """Handle all batches of the grid from ``epoch.next_batch`` on; ``emit`` gets the statistics."""
        while epoch.next_batch < grid.count:
            first = epoch.next_batch
            last = min(first + self.round_size, grid.count) - 1
            members = durable(self._members(rows, grid, first, last))
            changed, last_seen = self._first_change(epoch, members, last)
            if changed is None:
                self._score(epoch.model, members, grid, first, last_seen, None, emit)
                epoch.next_batch = last_seen + 1
                continue
            batch = durable(members.filter(F.col("batch_id") == changed).drop("batch_id"))
            model = self.select(batch)
            if self.score_before_refit:
                self._score(epoch.model, members, grid, first, changed, changed, emit)
            else:
                self._score(epoch.model, members, grid, first, changed - 1, None, emit)
                self._score(model, members, grid, changed, changed, changed, emit)
            epoch = Epoch(batch, model, Watch(self.panel), changed + 1)
        return epoch

    def _members(self, rows: DataFrame, grid: WindowGrid, first: int, last: int) -> DataFrame:
        """Rows of some batches, with ``batch_id``; batches with too few rows are left out."""
        low = grid.anchor + first * grid.offset
        part = WindowGrid(low, grid.size, grid.offset, last - first + 1)
        inside = in_time_range(rows, low, part.end, include_upper=False, on=ON)
        members = assign_batches(inside, part, ON).withColumn("batch_id", F.col("batch_id") + first)
        enough = members.groupBy("batch_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= self.least_rows)
        return members.join(enough.select("batch_id"), "batch_id", "left_semi")

    def _first_change(self, epoch: Epoch, members: DataFrame, last: int) -> tuple[int | None, int]:
        """First batch with a change, and the last batch looked at. At most ``round_size`` batches."""
        measured = batch_metrics(epoch.reference, members, self.columns, scaled=self.scaled, metrics=self.metrics)
        by_batch: dict[int, dict[str, float]] = {}
        for row in measured.collect():
            by_batch.setdefault(row.batch_id, {})[f"{row.classifier}/{row.metric}"] = row.value
        for batch in sorted(by_batch):
            if epoch.watch.feed(by_batch[batch]):
                return batch, batch
        return None, last

    def _score(
        self, model: Selection, members: DataFrame, grid: WindowGrid, first: int, last: int,
        changed: int | None, emit: Callable[[DataFrame], None],
    ) -> None:
        """Statistics of the batches from ``first`` to ``last``, as the run reports them."""
        if last < first:
            return
        scored = accuracy(
            model.predict(members.filter(F.col("batch_id").between(first, last))), ["batch_id"]
        )
        lower = grid.start_of(F.col("batch_id"))
        flag = F.lit(0) if changed is None else (F.col("batch_id") == changed).cast("int")
        emit(
            scored.select(
                "batch_id",
                flag.alias("drift_detection"),
                instant(lower + grid.offset).alias("batch_start"),
                instant(lower + grid.size).alias("batch_end"),
                "accuracy",
            )
        )


def scratch_table(df: DataFrame, name: str) -> str:
    """A new folder for a table in the checkpoint folder of the session."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def in_time_order(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows written down so that each file holds a short stretch of time.

    A round then reads the row groups of its batches and no others. The hash keeps a stretch
    with very many rows from being one file. Finding the ranges reads the rows once more, so
    they are computed into a table first.
    """
    computed, ordered = scratch_table(rows, "rows"), scratch_table(rows, "rows_by_time")
    reader = rows.sparkSession.read.schema(rows.schema)
    rows.write.parquet(computed)
    by_time = reader.parquet(computed).repartitionByRange(F.col(ON), F.xxhash64(*columns))
    by_time.sortWithinPartitions(ON).write.parquet(ordered)
    return reader.parquet(ordered)


def adapt(
    train: DataFrame, test: DataFrame, settings: Adaptive | None = None, stored: bool = False
) -> DataFrame:
    """Run the loop over labelled features; one row of run statistics per batch with rows enough.

    Every round reads its part of ``test``. It is written down in time order first, unless
    ``stored`` says that it is a table of that kind already.
    """
    settings = settings or Adaptive()
    rows = test if stored else in_time_order(test, settings.columns)
    folder = scratch_table(test, "run_statistics")
    spark = test.sparkSession
    spark.createDataFrame([], STATISTICS).write.parquet(folder)  # there may be no batch with rows enough
    settings.advance(
        settings.begin(train), rows, settings.grid(rows), lambda s: s.write.mode("append").parquet(folder)
    )
    return spark.read.schema(STATISTICS).parquet(folder)


def drift_regions(statistics: DataFrame, seconds: int = 60) -> DataFrame:
    """Where a change was found, as (start, end) of a fixed length."""
    return statistics.filter("drift_detection = 1").select(
        F.col("batch_start").alias("region_start"),
        (F.col("batch_start") + F.make_dt_interval(secs=F.lit(seconds))).alias("region_end"),
    )
