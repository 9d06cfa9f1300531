"""Change detectors: ordered folds over a metric series with a small state.

A detector is a class with ``add(value) -> bool`` and a JSON state, so the same fold runs
over a batch (:func:`detect`) and over a stream. Each follows its paper; every number is a
parameter. After a change a detector starts afresh with the next element.

A series has one value per batch of packets, so it is short next to the data it describes.
It is still read as a sorted stream of Arrow batches and never held as a whole.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Detector:
    """Base of all folds: state to and from JSON."""

    def add(self, value: float) -> bool:
        """Take the next element; true when it signals a change."""
        raise NotImplementedError

    def dump(self) -> str:
        return json.dumps(asdict(self))

    def load(self, state: str) -> Detector:
        for name, value in json.loads(state).items():
            setattr(self, name, value)
        return self


@dataclass
class Adwin(Detector):
    """Adaptive windowing (Bifet and Gavalda 2007).

    The window is a list of buckets (count, sum, squared deviations), oldest first, whose
    counts are powers of two with at most ``row`` of each. Every ``clock`` elements the window
    is cut where the means of its two parts differ by more than chance allows; the oldest
    bucket is dropped until no cut is left.
    """

    delta: float = 0.002
    clock: int = 32
    row: int = 5
    least_window: int = 10
    least_part: int = 5
    seen: int = 0
    buckets: list = field(default_factory=list)

    def add(self, value: float) -> bool:
        if math.isnan(value):
            return False
        self.seen += 1
        self.buckets.append([1, value, 0.0])
        self._compress()
        if self.seen % self.clock:
            return False
        change = False
        while self._has_cut():
            self.buckets.pop(0)
            change = True
        return change

    def _compress(self) -> None:
        end = len(self.buckets)
        while end:
            first, size = end, self.buckets[end - 1][0]
            while first and self.buckets[first - 1][0] == size:
                first -= 1
            if end - first <= self.row:
                return
            self.buckets[first:first + 2] = [_joined(self.buckets[first], self.buckets[first + 1])]
            end = first + 1

    def _has_cut(self) -> bool:
        if sum(b[0] for b in self.buckets) <= self.least_window:
            return False
        whole = [0, 0.0, 0.0]
        for bucket in self.buckets:
            whole = _joined(whole, bucket)
        n, total, spread = whole
        variance = spread / n
        chance = math.log(2.0 * math.log(n) / self.delta)
        old_n, old_sum = 0, 0.0
        for count, value, _ in self.buckets[:-1]:
            old_n, old_sum = old_n + count, old_sum + value
            new_n = n - old_n
            if old_n < self.least_part or new_n < self.least_part:
                continue
            weight = 1.0 / old_n + 1.0 / new_n
            bound = math.sqrt(2.0 * weight * variance * chance) + 2.0 / 3.0 * weight * chance
            if abs(old_sum / old_n - (total - old_sum) / new_n) > bound:
                return True
        return False


def _joined(a: list, b: list) -> list:
    """Count, sum and squared deviations of two groups taken together."""
    if not a[0] or not b[0]:
        return list(b if not a[0] else a)
    apart = a[1] / a[0] - b[1] / b[0]
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2] + apart * apart * a[0] * b[0] / (a[0] + b[0])]


def _deviation(p: float, n: int) -> float:
    """Standard deviation of a rate; not a number outside [0, 1]."""
    square = p * (1.0 - p) / n
    return math.sqrt(square) if square >= 0 else math.nan


@dataclass
class Ddm(Detector):
    """Drift detection method (Gama et al. 2004): the error rate leaves its lowest level."""

    least: int = 30
    level: float = 3.0
    n: int = 0
    rate: float = 0.0
    low_rate: float = math.inf
    low_dev: float = math.inf

    def add(self, value: float) -> bool:
        self.n += 1
        self.rate += (value - self.rate) / self.n
        dev = _deviation(self.rate, self.n)
        if self.n < self.least:
            return False
        if self.rate + dev <= self.low_rate + self.low_dev:
            self.low_rate, self.low_dev = self.rate, dev
        if self.rate + dev > self.low_rate + self.level * self.low_dev:
            self.n, self.rate, self.low_rate, self.low_dev = 0, 0.0, math.inf, math.inf
            return True
        return False


@dataclass
class Eddm(Detector):
    """Early drift detection (Baena-Garcia et al. 2006): errors come closer together."""

    least: int = 30
    ratio: float = 0.9
    n: int = 0
    errors: int = 0
    last: int = 0
    mean: float = 0.0
    squares: float = 0.0
    highest: float = 0.0

    def add(self, value: float) -> bool:
        self.n += 1
        if value != 1.0:
            return False
        self.errors += 1
        distance, self.last = self.n - self.last, self.n
        before = self.mean
        self.mean += (distance - self.mean) / self.errors
        self.squares += (distance - self.mean) * (distance - before)
        reach = self.mean + 2.0 * math.sqrt(self.squares / self.errors)
        if self.n < self.least:
            return False
        if reach > self.highest:
            self.highest = reach
        elif self.errors >= self.least and reach < self.ratio * self.highest:
            self.n = self.errors = self.last = 0
            self.mean = self.squares = self.highest = 0.0
            return True
        return False


@dataclass
class HddmA(Detector):
    """Hoeffding bounds on averages (Frias-Blanco et al. 2015).

    A rise of the mean is a change. With ``two_sided`` a fall restarts the statistics quietly.
    """

    confidence: float = 0.001
    two_sided: bool = True
    n: int = 0
    total: float = 0.0
    low_n: int = 0
    low: float = 0.0
    high_n: int = 0
    high: float = 0.0

    def add(self, value: float) -> bool:
        if math.isnan(value):
            return False
        self.n += 1
        self.total += value
        if not self.low_n:
            self.low_n, self.low = self.n, self.total
        if not self.high_n:
            self.high_n, self.high = self.n, self.total
        mean, here = self.total / self.n, self._slack(self.n)
        if self.low / self.low_n + self._slack(self.low_n) >= mean + here:
            self.low_n, self.low = self.n, self.total
        if self.high / self.high_n - self._slack(self.high_n) <= mean - here:
            self.high_n, self.high = self.n, self.total
        if self._apart(self.low_n) <= mean - self.low / self.low_n and self.low_n < self.n:
            self._restart()
            return True
        if self.two_sided and self.high_n < self.n and (
            self._apart(self.high_n) <= self.high / self.high_n - mean
        ):
            self._restart()
        return False

    def _slack(self, n: int) -> float:
        return math.sqrt(math.log(1.0 / self.confidence) / (2.0 * n))

    def _apart(self, n: int) -> float:
        return math.sqrt((self.n - n) / (n * self.n) / 2.0 * math.log(2.0 / self.confidence))

    def _restart(self) -> None:
        self.n = self.low_n = self.high_n = 0
        self.total = self.low = self.high = 0.0


@dataclass
class HddmW(Detector):
    """McDiarmid bounds on exponentially weighted averages (Frias-Blanco et al. 2015).

    A pair is (average, sum of squared weights); an empty one is null. ``low`` is the average
    at its lowest bound and ``after_low`` the one since then, the other pair mirrors it.
    """

    confidence: float = 0.001
    decay: float = 0.05
    two_sided: bool = True
    total: list | None = None
    low: list | None = None
    after_low: list | None = None
    low_bound: float = math.inf
    high: list | None = None
    after_high: list | None = None
    high_bound: float = -math.inf

    def add(self, value: float) -> bool:
        if math.isnan(value):
            return False
        self.total = self._weighted(self.total, value)
        bound = self._bound(self.total[1])
        if self.total[0] + bound < self.low_bound:
            self.low_bound, self.low, self.after_low = self.total[0] + bound, list(self.total), None
        else:
            self.after_low = self._weighted(self.after_low, value)
        if self._rises(self.low, self.after_low):
            self._restart()
            return True
        if self.total[0] - bound > self.high_bound:
            self.high_bound, self.high, self.after_high = self.total[0] - bound, list(self.total), None
        else:
            self.after_high = self._weighted(self.after_high, value)
        if self.two_sided and self._rises(self.after_high, self.high):
            self._restart()
        return False

    def _weighted(self, pair: list | None, value: float) -> list:
        if pair is None:
            return [value, 1.0]
        keep = 1.0 - self.decay
        return [self.decay * value + keep * pair[0], self.decay ** 2 + keep ** 2 * pair[1]]

    def _bound(self, weights: float) -> float:
        return math.sqrt(weights * math.log(1.0 / self.confidence) / 2.0)

    def _rises(self, before: list | None, after: list | None) -> bool:
        if before is None or after is None:
            return False
        return after[0] - before[0] > self._bound(before[1] + after[1])

    def _restart(self) -> None:
        self.total = self.low = self.after_low = self.high = self.after_high = None
        self.low_bound, self.high_bound = math.inf, -math.inf


@dataclass
class Kswin(Detector):
    """Kolmogorov-Smirnov windowing (Raab et al. 2020).

    The newest values are tested against as many older ones, drawn with replacement. The draw
    is a hash of the position in the series, so a run can be repeated.
    """

    level: float = 0.005
    window: int = 100
    newest: int = 30
    least_distance: float = 0.1
    seed: int = 0
    seen: int = 0
    values: list = field(default_factory=list)

    def add(self, value: float) -> bool:
        if math.isnan(value):
            return False
        self.seen += 1
        change = False
        if len(self.values) >= self.window:
            self.values.pop(0)
            older, recent = self.values[:-self.newest], self.values[-self.newest:]
            drawn = [older[self._pick(i, len(older))] for i in range(self.newest)]
            distance = ks_distance(drawn, recent)
            change = distance > self.least_distance and ks_chance(distance, self.newest) <= self.level
            if change:
                self.values = recent
        self.values.append(value)
        return change

    def _pick(self, draw: int, among: int) -> int:
        return zlib.crc32(f"{self.seed}/{self.seen}/{draw}".encode()) % among


def ks_distance(a: Sequence[float], b: Sequence[float]) -> float:
    """Largest distance between two empirical distributions."""
    a, b = sorted(a), sorted(b)
    return max(abs(bisect_right(a, x) / len(a) - bisect_right(b, x) / len(b)) for x in a + b)


def ks_chance(distance: float, n: int) -> float:
    """Exact chance of at least this distance between two samples of size n (Gnedenko and Korolyuk)."""
    steps = round(distance * n)
    if steps == 0:
        return 1.0
    whole = math.comb(2 * n, n)
    terms = range(1, n // steps + 1)
    return min(1.0, 2.0 * sum((-1) ** (j + 1) * math.comb(2 * n, n - j * steps) for j in terms) / whole)


@dataclass
class PageHinkley(Detector):
    """Page-Hinkley test (Page 1954): the mean rises for long enough."""

    least: int = 30
    delta: float = 0.005
    threshold: float = 50.0
    forget: float = 0.9999
    n: int = 0
    mean: float = 0.0
    rise: float = 0.0

    def add(self, value: float) -> bool:
        if math.isnan(value):
            return False
        self.n += 1
        self.mean += (value - self.mean) / self.n
        self.rise = max(0.0, self.forget * self.rise + value - self.mean - self.delta)
        if self.n >= self.least and self.rise > self.threshold:
            self.n, self.mean, self.rise = 0, 0.0, 0.0
            return True
        return False


# The panel of detectors, each with its default settings.
DETECTORS: dict[str, Callable[[], Detector]] = {
    "ADWIN": Adwin,
    "DDM": Ddm,
    "EDDM": Eddm,
    "HDDM_A": HddmA,
    "HDDM_W": HddmW,
    "KSWIN": Kswin,
    "PageHinkley": PageHinkley,
}


def fresh(panel: Mapping[str, Callable[[], Detector]]) -> dict[str, Detector]:
    return {name: make() for name, make in panel.items()}


def _detection_schema(series: DataFrame, keys: Sequence[str], seq: str) -> T.StructType:
    kinds = {f.name: f.dataType for f in series.schema.fields}
    return T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField(seq, kinds[seq]), T.StructField("detector", T.StringType()),
           T.StructField("change", T.IntegerType())]
    )


def detect(
    series: DataFrame,
    keys: Sequence[str],
    seq: str = "seq",
    value: str = "value",
    panel: Mapping[str, Callable[[], Detector]] = DETECTORS,
) -> DataFrame:
    """Run a panel of detectors over every series, in the order of ``seq``.

    ``keys`` tell the series apart; a new key value starts new detectors. One row comes back
    per element and detector, with ``change`` 0 or 1. Elements without a value are left out.
    """
    found = detect_onwards(series, keys, None, seq, value, panel)
    return found.where("state IS NULL").drop("state")


def detect_onwards(
    series: DataFrame,
    keys: Sequence[str],
    states: DataFrame | None,
    seq: str = "seq",
    value: str = "value",
    panel: Mapping[str, Callable[[], Detector]] = DETECTORS,
) -> DataFrame:
    """:func:`detect` that goes on from the states of an earlier call.

    ``states`` has the rows with a ``state`` of that call's result, or is None at the start. The
    result has one row per element and detector, and one row with ``state`` (and without
    ``change``) per series and detector, ``seq`` being the last element it has seen. Elements up
    to that one are repeats and are left out, so that a call may be made again with more rows.
    A series without new elements keeps its state; a detector new to the panel starts afresh.
    """
    keys = list(keys)
    schema = _detection_schema(series, keys, seq).add("state", T.StringType())
    number = F.col(value).cast("double")
    rows = series.where(number.isNotNull() & ~F.isnan(number)).select(
        *keys, F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("detector"),
        F.col(seq), number.alias(value),
    )
    if states is not None:
        held = states.where("state IS NOT NULL").select(
            *keys, "state", "detector", F.col(seq).cast(schema[seq].dataType), F.lit(None).cast("double").alias(value)
        )
        rows = rows.unionByName(held)

    def closed(key: tuple, detectors: dict[str, Detector], last: dict) -> list[tuple]:
        return [(*key, last[n], n, None, d.dump()) for n, d in detectors.items() if last.get(n) is not None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, detectors, before, last = None, {}, {}, {}
        for pdf in batches:
            out = []
            # columns as Python objects, so that a missing state does not turn numbers into floats
            for row in zip(*[pdf[c].tolist() for c in pdf.columns]):
                key, (state, name, at, number) = row[: len(keys)], row[len(keys) :]
                if key != current:
                    out += closed(current, detectors, last) if current is not None else []
                    current, detectors, before, last = key, fresh(panel), {}, {}
                if isinstance(state, str):
                    if name in detectors:
                        detectors[name].load(state)
                        before[name] = last[name] = at
                    continue
                for name, one in detectors.items():
                    if name not in before or at > before[name]:
                        out.append((*key, at, name, int(one.add(number)), None))
                        last[name] = at
            yield pd.DataFrame(out, columns=schema.names).astype({"change": "Int32"})
        if current is not None:
            yield pd.DataFrame(closed(current, detectors, last), columns=schema.names).astype({"change": "Int32"})

    return (
        rows.repartition(*keys)
        .sortWithinPartitions(*keys, F.col("state").isNull(), seq)
        .mapInPandas(run, schema)
    )


def consensus(predictions: DataFrame, by: Sequence[str] = (), change: str = "prediction") -> DataFrame:
    """1 when any detector signals a change, per group of ``by`` or over all rows."""
    return predictions.groupBy(*by).agg(F.max(change).alias("consensus"))
