"""Change detectors on a stream of metric values: the batch folds with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from flowlens.functions.timerange import micros_of
from flowlens.operators.detectors import DETECTORS, Detector
from flowlens.streaming.keyed import OrderedBuffer, keyed_state, one_each

ELEMENT = np.dtype([("at", "<i8"), ("ms", "<i8"), ("value", "<f8")])


class OrderedDetector(StatefulProcessor):
    """One detector over one series, keyed by (series, detector).

    Elements wait in an ordered buffer until the watermark has reached their time; then they are
    folded in order of their number, a leaf of the buffer at a time. What comes at or before the
    last folded number is a repeat or late and is left out.
    """

    def __init__(self, panel: Mapping[str, Callable[[], Detector]], names: Sequence[str]) -> None:
        self.panel, self.names = dict(panel), list(names)

    def init(self, handle) -> None:
        self.handle = handle
        self.elements = OrderedBuffer(handle, ELEMENT, one_each)
        self.fold = handle.getValueState("fold", "last bigint, detector string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.fold.get()[0] if self.fold.exists() else None
        first_ms = last_ms = None
        for pdf in rows:
            new = np.empty(len(pdf), ELEMENT)
            new["at"], new["ms"], new["value"] = pdf["element_number"], pdf["element_ms"], pdf["element_value"]
            if last is not None:
                new = new[new["at"] > last]
            if len(new):
                low, high = int(new["ms"].min()), int(new["ms"].max())
                first_ms = low if first_ms is None else min(first_ms, low)
                last_ms = high if last_ms is None else max(last_ms, high)
                self.elements.add(new)
        for ms in {first_ms, last_ms} - {None}:
            self.handle.registerTimer(ms)
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Fold what the watermark has passed."""
        passed = timerValues.getCurrentWatermarkInMs()
        detector, last = self.panel[key[-1]](), None
        if self.fold.exists():
            detector.load(self.fold.get()[1])
        for part in self.elements.taken(lambda rows: int(np.argmax([*(rows["ms"] > passed), True]))):
            rows = [
                (*key[:-1], at, key[-1], int(detector.add(value)))
                for at, value in zip(part["at"].tolist(), part["value"].tolist())
            ]
            last = rows[-1][len(key) - 1]
            yield pd.DataFrame(rows, columns=self.names)
        if last is not None:
            self.fold.update((last, detector.dump()))


def stream_detect(
    series: DataFrame,
    keys: Sequence[str],
    time: str,
    delay: str,
    seq: str = "seq",
    value: str = "value",
    panel: Mapping[str, Callable[[], Detector]] = DETECTORS,
) -> DataFrame:
    """Run a panel of detectors over every series of a stream.

    ``time`` is the event time of an element; it does not fall as ``seq`` rises. Elements may
    come in any order within ``delay``; an element is judged once the watermark has reached its
    time. The result is that of :func:`flowlens.operators.detectors.detect` on the same elements.
    Those without a value, or later than the watermark, are left out.
    """
    keyed_state(series.sparkSession)
    keys = list(keys)
    kinds = {f.name: f.dataType for f in series.schema.fields}
    output = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField(seq, kinds[seq]), T.StructField("detector", T.StringType()),
           T.StructField("change", T.IntegerType())]
    )
    number = F.col(value).cast("double")
    rows = (
        series.withColumn("element_time", F.col(time).cast("timestamp"))
        .withWatermark("element_time", delay)
        .where(number.isNotNull() & ~F.isnan(number) & F.col("element_time").isNotNull() & F.col(seq).isNotNull())
        .select(
            *keys, "element_time", F.col(seq).cast("long").alias("element_number"), number.alias("element_value"),
            F.ceil(micros_of("element_time") / 1000).cast("long").alias("element_ms"),
            F.explode(F.array(*[F.lit(name) for name in panel])).alias("detector"),
        )
    )
    return rows.groupBy(*keys, "detector").transformWithStateInPandas(
        OrderedDetector(panel, output.names), output, "append", "eventTime"
    )

