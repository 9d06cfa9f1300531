"""The adaptive loop as a ``foreachBatch`` sink for labelled feature rows of closed windows.

Everything the loop needs lives in one shared folder, in tables with a version per
micro-batch: the feature rows, the run statistics, the detectors, the reference and the
model. A micro-batch that is run again after a failure finds its version and writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timerange import in_time_range, micros_of
from flowlens.operators.windows import SECOND, WindowGrid
from flowlens.plans.adapt import ON, STATISTICS, Adaptive, Epoch, Watch
from flowlens.plans.models import Selection
from flowlens.streaming.versions import RANGE, VersionedRows, latest, write_row

STATE = (
    "version long, ended boolean, anchor long, next_batch long, newest long, late long, "
    f"held array<struct<{RANGE.replace(' bigint', ':bigint')}>>, detectors string, "
    "reference string, model string, model_name string"
)


@dataclass(frozen=True)
class AdaptiveSink:
    """Use as ``stream.writeStream.foreachBatch(AdaptiveSink(folder, settings))``.

    :meth:`begin` must have stored the first model and reference, and :meth:`finish` handles the
    last batches when the stream has ended. Rows may come ``delay_seconds`` out of order: a batch
    closes when a row that much newer than its end has come. A row older than every batch that is
    still open counts as late. Each micro-batch reads the versions that its open batches reach.
    """

    folder: str
    settings: Adaptive
    delay_seconds: float = 0

    def begin(self, train: DataFrame, anchor: int) -> None:
        """Choose the first model on training rows; batches are counted from ``anchor``."""
        spark = train.sparkSession
        spark.createDataFrame([], STATISTICS).write.mode("overwrite").parquet(f"{self.folder}/statistics/version=begin")
        self._save(spark, self.settings.begin(train), (-1, False, anchor, 0, None, 0, []), None)

    def __call__(self, rows: DataFrame, micro_batch: int) -> None:
        spark = rows.sparkSession
        state = latest(spark, STATE, f"{self.folder}/state")
        if state.version >= micro_batch:
            return
        if state.ended:
            raise ValueError("the run has ended; begin another in a new folder")
        low = self._low(state)
        held = VersionedRows(f"{self.folder}/features")
        written = rows.withColumn("_late", micros_of(ON) < low)
        mine = held.write(written, micro_batch, micros_of(ON))
        schema = written.schema
        late = held.read(spark, schema, mine, -(1 << 62)).where("_late").count()
        newest = max([state.newest, *[r[2] for r in mine]], key=lambda x: -(1 << 62) if x is None else x)
        ranges = VersionedRows.still_needed([*state.held, *mine], low)
        place = (micro_batch, False, state.anchor, state.next_batch, newest, state.late + late, ranges)
        passed = None if newest is None else newest - int(self.delay_seconds * SECOND)
        self._advance(spark, state, place, held.read(spark, schema, ranges, low).drop("_late"), self._closed(state.anchor, passed))

    def finish(self, spark: SparkSession, schema) -> None:
        """Handle the batches that only the end of the stream closes, as the batch run counts them.

        ``schema`` is that of the feature rows. Calling it again changes nothing.
        """
        state = latest(spark, STATE, f"{self.folder}/state")
        if state.ended:
            return
        size, offset = self._sizes()
        last = -1 if state.newest is None else (state.newest - size + offset - state.anchor) // offset
        grid = WindowGrid(state.anchor, size, offset, max(last + 1, 0))
        rows = VersionedRows(f"{self.folder}/features").read(spark, schema, state.held, self._low(state))
        place = (state.version, True, state.anchor, state.next_batch, state.newest, state.late, state.held)
        self._advance(spark, state, place, rows, grid)

    def statistics(self, spark: SparkSession) -> DataFrame:
        """Run statistics so far."""
        return spark.read.schema(STATISTICS).parquet(f"{self.folder}/statistics/version=*")

    def late(self, spark: SparkSession) -> int:
        """How many rows came after the batches they belong to had closed."""
        return latest(spark, STATE, f"{self.folder}/state").late

    def _sizes(self) -> tuple[int, int]:
        return int(self.settings.batch_seconds * SECOND), int(self.settings.offset_seconds * SECOND)

    def _low(self, state) -> int:
        """Where the first open batch begins."""
        return state.anchor + state.next_batch * self._sizes()[1]

    def _closed(self, anchor: int, passed: int | None) -> WindowGrid:
        """Batches that end no later than the newest window start that no open row can precede."""
        size, offset = self._sizes()
        return WindowGrid(anchor, size, offset, 0 if passed is None else max((passed + 1 - size - anchor) // offset + 1, 0))

    def _advance(self, spark: SparkSession, state, place: tuple, rows: DataFrame, grid: WindowGrid) -> None:
        epoch = before = self._load(spark, state)
        name = "end" if place[1] else place[0]
        statistics: list[DataFrame] = []
        if grid.count > epoch.next_batch:
            kept = in_time_range(rows, self._low(state), on=ON)
            epoch = self.settings.advance(epoch, kept, grid, statistics.append)
        for part, table in enumerate(statistics):
            mode = "overwrite" if part == 0 else "append"
            table.select(*[c.split()[0] for c in STATISTICS.split(", ")]).write.mode(mode).parquet(
                f"{self.folder}/statistics/version={name}"
            )
        self._save(spark, epoch, place, state if epoch is before else None)

    def _load(self, spark: SparkSession, state) -> Epoch:
        model = Selection(PipelineModel.load(state.model), state.model_name, ())
        watch = Watch(self.settings.panel).load(state.detectors)
        return Epoch(spark.read.parquet(state.reference), model, watch, state.next_batch)

    def _save(self, spark: SparkSession, epoch: Epoch, place: tuple, same) -> None:
        """Write the state of a version; an unchanged epoch points to the tables it had."""
        version, ended, anchor, _, newest, late, ranges = place
        name = f"{version}-end" if ended else f"{version}"
        reference = same.reference if same else f"{self.folder}/reference/v{name}"
        model = same.model if same else f"{self.folder}/model/v{name}"
        if not same:
            epoch.reference.write.mode("overwrite").parquet(reference)
            epoch.model.model.write().overwrite().save(model)
        low = anchor + epoch.next_batch * self._sizes()[1]
        held = VersionedRows.still_needed(ranges, low)
        row = (version, ended, anchor, epoch.next_batch, newest, late, held, epoch.watch.dump(), reference, model, epoch.model.name)
        write_row(spark, row, STATE, f"{self.folder}/state/v{name}")
