"""Detector states that outlive a call: a table per call, in a folder that all machines share."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from flowlens.operators.detectors import DETECTORS, Detector, detect_onwards


@dataclass(frozen=True)
class DetectorStore:
    """Runs a panel over the next elements of its series, from where the last call stopped.

    A call writes one table: the predictions of its elements and the state of every (series,
    detector) after them. It counts once it is written as a whole, so a call that failed is made
    again and finds the state before it. Elements that a call before has seen are left out. An
    earlier table is read only until the next one is there.
    """

    folder: str
    keys: Sequence[str]
    seq: str = "seq"
    value: str = "value"
    panel: Mapping[str, Callable[[], Detector]] = field(default_factory=lambda: DETECTORS)

    def detect(self, series: DataFrame) -> DataFrame:
        """Predictions for new elements: the keys, ``seq``, ``detector`` and ``change``."""
        spark = series.sparkSession
        done = self.calls(spark)
        found = detect_onwards(series, self.keys, self._read(spark, done), self.seq, self.value, self.panel)
        return self._write(found, done + 1).where("state IS NULL").drop("state")

    def reset(self, spark: SparkSession) -> None:
        """Start all detectors afresh with the next element, as a new reference asks for."""
        done = self.calls(spark)
        held = self._read(spark, done)
        if held is not None:
            self._write(held.limit(0), done + 1)

    def states(self, spark: SparkSession) -> DataFrame | None:
        """The states after the last call; None before the first."""
        held = self._read(spark, self.calls(spark))
        return held if held is None else held.where("state IS NOT NULL").drop("change")

    def log(self, spark: SparkSession) -> DataFrame:
        """The predictions of all calls."""
        return spark.read.parquet(f"{self.folder}/call=*").where("state IS NULL").drop("state")

    def calls(self, spark: SparkSession) -> int:
        """How many calls are written as a whole."""
        context = spark.sparkContext
        made = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/call=*/_SUCCESS")
        found = made.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(made)
        numbers = [int(str(s.getPath().getParent().getName()).removeprefix("call=")) for s in found or []]
        return max(numbers, default=0)

    def _read(self, spark: SparkSession, call: int) -> DataFrame | None:
        return spark.read.parquet(f"{self.folder}/call={call}") if call else None

    def _write(self, table: DataFrame, call: int) -> DataFrame:
        path = f"{self.folder}/call={call}"
        table.write.mode("overwrite").parquet(path)
        return table.sparkSession.read.schema(table.schema).parquet(path)
