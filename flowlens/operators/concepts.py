"""Concept comparison: cluster reference and batch rows together, for many batches at once.

Two ways lead to the same clusters. When every batch of a round, reference included, has at
most ``TASK_ROWS`` rows, one shuffle brings each batch to a task that runs all steps. Beyond
that the rows stay where they are, packed into blocks of one batch each, and a look is a scan of
all blocks against the centroids of every batch and start that has not settled. A look does more
than one step: rows that are far from the border between the two centroids cannot change sides
before the centroids have moved by so much, so a task per batch and start gets their counts and
sums only, and the rows near the border themselves, and goes on from there. What it gets is
bounded by ``CLOSE_ROWS``; the steps are the same as if each were a scan. The driver holds the
centroids of each batch; callers take the batches in rounds of ``MAX_BATCHES``, so their size is
bounded.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import batched
from math import inf
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOLERANCE = 1e-4
MAX_BATCHES = 10_000
TASK_ROWS = 100_000
#: Inertias that differ by less than this share count as equal.
LEVEL = 1e-9
#: Rows of a batch and start near the border that go to one task: so many, and this part of the batch, at most.
CLOSE_ROWS, CLOSE_SHARE = 100_000, 5
#: More batches are put in order before their rows are packed.
FEW_BATCHES = 50
#: Several times the rounding error of one addition, relative to the sum.
ROUNDING = 1e-15
#: The size of a gap of 0, below all others.
NO_GAP = -2000


def batch_ids(batches: DataFrame) -> list[int]:
    """Numbers of the batches, in order. Each gives six numbers, which the detectors read one by one."""
    found = batches.select("batch_id").where("batch_id IS NOT NULL").distinct().collect()
    return sorted(row.batch_id for row in found)


def label_concepts(
    reference: DataFrame, batches: DataFrame, columns: Sequence[str], ids: Sequence[int]
) -> DataFrame:
    """Reference rows with concept 0 once for each batch, batch rows with concept 1.

    The reference is repeated in place, by a projection, not by a join.
    """
    as_double = [F.col(c).cast("double").alias(c) for c in columns]
    every = F.explode(F.lit([int(i) for i in ids]).cast("array<bigint>")).alias("batch_id")
    old = reference.select(every, *as_double, F.lit(0).alias("concept"))
    new = batches.select(F.col("batch_id").cast("long").alias("batch_id"), *as_double, F.lit(1).alias("concept"))
    return old.unionByName(new)


def standardize(rows: DataFrame, columns: Sequence[str], by: str = "batch_id") -> DataFrame:
    """Scale every column to mean 0 and deviation 1 within its batch; constant columns become 0."""
    stats = rows.groupBy(by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    others = [c for c in rows.columns if c not in columns]
    return rows.join(stats, by).select(
        *others,
        *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)).alias(c)
          for c in columns],
    )


def _apart(cells: np.ndarray, point: Sequence[float]) -> np.ndarray:
    """Squared distances to a point. ``cells`` has a row per feature; they are added up in that order."""
    total, point = np.zeros(cells.shape[1]), np.asarray(point)[:, None]
    for begin in range(0, len(total), 4096):  # as many rows as the processor keeps at hand
        off = cells[:, begin : begin + 4096] - point
        off *= off
        # a lone row would be added up in another order
        total[begin : begin + 4096] = off.sum(axis=0) if off.shape[1] > 1 else np.add.accumulate(off)[-1]
    return total


def _row(cells: np.ndarray, among: np.ndarray, last: int = 0) -> tuple[float, ...]:
    """The smallest of some rows in column order, or with ``last`` -1 the largest."""
    some = cells[:, among]
    return tuple(some[:, np.lexsort(some[::-1])[last]].tolist())


def _farthest(cells: np.ndarray, point: Sequence[float]) -> tuple:
    """The least of these tuples ends with the row farthest from a point, of equally far ones the smallest."""
    apart = _apart(cells, point)
    top = float(apart.max())
    if top != top:  # not a number counts as farther than all
        return 0, 0.0, _row(cells, np.isnan(apart))
    return 1, -top, _row(cells, apart == top)


def _lowest(cells: np.ndarray, column: int) -> tuple:
    least = cells[column].min()
    return least, _row(cells, cells[column] == least)


def _highest(cells: np.ndarray, column: int) -> tuple:
    most = cells[column].max()
    return most, _row(cells, cells[column] == most, -1)


def _widest(variance: np.ndarray, starts: int) -> list[int]:
    """The columns of largest variance, one for each start after the first."""
    return np.argsort(-variance, kind="stable")[: starts - 1].tolist()


def _sums(cells: np.ndarray, near_b: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of some rows on either side."""
    sides = np.array([~near_b & some, near_b & some])
    added = sides.astype("float64") @ cells.T
    if not np.isfinite(added).all():  # an infinite value counts on its own side only
        added = np.array([cells[:, side].sum(axis=1) for side in sides])
    return sides.sum(axis=1), added


def _shift(old: Sequence, new: Sequence) -> float:
    """How far two points have moved, added up."""
    return sum(float(np.sqrt(((np.asarray(x) - y) ** 2).sum())) for x, y in zip(old, new))


class _Looked(NamedTuple):
    """What a look leaves of rows: those near the border as they are, of the others counts and sums."""

    counts: np.ndarray
    sums: np.ndarray
    close: list[np.ndarray]
    gaps: dict[int, int]

    def joined(self, other: _Looked) -> _Looked:
        gaps = {k: self.gaps.get(k, 0) + other.gaps.get(k, 0) for k in self.gaps.keys() | other.gaps.keys()}
        return _Looked(self.counts + other.counts, self.sums + other.sums, self.close + other.close, gaps)


@np.errstate(invalid="ignore", over="ignore", under="ignore")
def _look(cells: np.ndarray, points: Sequence, reach: float) -> _Looked:
    """Rows whose distances to two points differ by less than ``reach`` are close; all are counted by that gap.

    The size of a gap is a power of the fourth root of two above it. A gap is taken as smaller by
    more than it can be wrong, so that rounding cannot move a row beyond it either.
    """
    to_a, to_b = _apart(cells, points[0]), _apart(cells, points[1])
    near_b = to_b < to_a
    to_a, to_b = np.sqrt(to_a), np.sqrt(to_b)
    gap = np.abs(to_a - to_b) - ROUNDING * (len(cells) + 4) * (to_a + to_b)
    gap[~(gap > 1e-75)] = 0
    close = gap < reach
    sizes, rows = np.unique(np.where(gap > 0, np.frexp(np.square(gap * gap))[1], NO_GAP), return_counts=True)
    gaps = dict(zip(sizes.tolist(), rows.tolist()))
    return _Looked(*_sums(cells, near_b, ~close), [cells[:, close]] if close.any() else [], gaps)


def _below(gaps: dict[int, int], room: int) -> float:
    """A gap that no more than so many rows are below."""
    rows, bound = 0, 0.0
    for size in sorted(gaps):
        rows += gaps[size]
        if rows > room:
            break
        bound = 2.0 ** (size / 4)
    return bound


def _reach(gaps: dict[int, int], shift: float, speed: float) -> float:
    """How close a row is to be kept by the next look, after the points have moved by ``shift`` since the last.

    Rows that have come closer than a bound without the shift were below the bound, by the triangle
    inequality, so they are no more than were. A third of them is aimed at, as the others hardly
    come. It is 0, for a single step, while a step moves the points so far that no more is gained.
    """
    room = min(CLOSE_ROWS, sum(gaps.values()) // CLOSE_SHARE)
    reach = min(_below(gaps, room // 3), _below(gaps, room) - shift)
    return reach if reach > speed else 0.0


class _Pair(NamedTuple):
    """Two centroids on their way, the reach of the next look, and the steps left if they are bounded."""

    points: Sequence
    reach: float
    left: int | None
    settled: bool = False

    @np.errstate(invalid="ignore", over="ignore")
    def after(self, looked: _Looked, still: float) -> _Pair:
        """One step, and more as long as only close rows can change sides."""
        close = np.concatenate(looked.close, axis=1, dtype="float64") if looked.close else None
        points, left = self.points, self.left
        while True:
            counts, sums = looked.counts, looked.sums
            if close is not None:
                near_b = _apart(close, points[1]) < _apart(close, points[0])
                more = _sums(close, near_b, np.ones(len(near_b), dtype=bool))
                counts, sums = counts + more[0], sums + more[1]
            old, new = points, [total / n if n else np.asarray(at) for total, n, at in zip(sums, counts, points)]
            moved = sum(float(((x - y) ** 2).sum()) for x, y in zip(new, old))
            points, left = new, left and left - 1
            settled = not moved > still or left == 0
            shift = _shift(self.points, points)
            if settled or not shift * (1 + LEVEL) < self.reach:
                return _Pair(points, _reach(looked.gaps, shift, _shift(old, new)), left, settled)


def _inertia(cells: np.ndarray, points: Sequence) -> float:
    """Squared distances of rows to the nearer point, summed."""
    return float(np.minimum(_apart(cells, points[0]), _apart(cells, points[1])).sum())


def _side(cells: np.ndarray, points: Sequence) -> np.ndarray:
    return (_apart(cells, points[1]) < _apart(cells, points[0])).astype("int32")


def _best(found: Sequence[tuple[Sequence, float]]) -> list[list[float]]:
    """The points of least inertia, the earlier ones of equal ones; in ascending order."""
    best, least = found[0]
    for points, apart in found[1:]:
        if apart < least * (1 - LEVEL):
            best, least = points, apart
    return sorted(np.asarray(point).tolist() for point in best)


def _cluster_one(cells: np.ndarray, steps: int | None, tolerance: float, starts: int) -> np.ndarray:
    """All steps on the rows of one batch from every start; the clusters of least inertia."""
    variance = cells.var(axis=1)
    first = _farthest(cells, cells.mean(axis=1))[-1]
    pairs = [(first, _farthest(cells, first)[-1])]
    pairs += [(_lowest(cells, c)[-1], _highest(cells, c)[-1]) for c in _widest(variance, starts)]
    found = []
    for points in pairs:
        # few rows are all close, for good
        pair = _Pair(points, inf if cells.shape[1] <= CLOSE_ROWS else 0.0, steps, steps == 0)
        while not pair.settled:
            pair = pair.after(_look(cells, pair.points, pair.reach), variance.mean() * tolerance)
        found.append((pair.points, _inertia(cells, pair.points)))
    return _side(cells, _best(found))


def _cluster_in_tasks(
    rows: DataFrame, columns: Sequence[str], by: str, steps: int | None, tolerance: float, starts: int
) -> DataFrame:
    columns = list(columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.ascontiguousarray(pdf[columns].to_numpy(dtype="float64").T)
        return pdf.assign(cluster=_cluster_one(cells, steps, tolerance, starts))

    schema = T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType())])
    return rows.groupBy(by).applyInPandas(run, schema)


def _by_batch(batch: pa.Array, columns: Sequence[pa.Array]) -> Iterator[tuple[Any, np.ndarray, np.ndarray]]:
    """Each batch of some rows, where its rows without a missing feature are, and their features."""
    cells = np.array([c.to_numpy(zero_copy_only=False) for c in columns], dtype="float64")
    coded = batch.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy()
    whole = np.flatnonzero(~np.isnan(cells).any(axis=0))
    whole = whole[np.argsort(codes[whole], kind="stable")]
    ends = np.cumsum(np.bincount(codes[whole], minlength=len(coded.dictionary)))
    for key, begin, end in zip(coded.dictionary.to_pylist(), [0, *ends], ends):
        if begin < end:
            yield key, whole[begin:end], cells[:, whole[begin:end]]


class _Blocks:
    """Rows without a missing feature as blocks: a batch and the features of some of its rows, column after column."""

    def __init__(self, rows: DataFrame, columns: Sequence[str], by: str, batches: int):
        self.by, self.wide = by, len(columns)
        self.kind = T.StructField(by, rows.schema[by].dataType)
        plain = rows.where(F.col(by).isNotNull()).select(by, *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(columns)])
        if batches > FEW_BATCHES:  # or the rows of a batch would be scattered over blocks of few
            plain = plain.sortWithinPartitions(by)

        def pack(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in tables:
                keys, counts, blocks = [], [], []
                for key, places, cells in _by_batch(table.column(0), table.columns[1:]):
                    with np.errstate(over="ignore", under="ignore"):
                        small = cells.astype("float32")
                    keys.append(key)
                    counts.append(len(places))
                    lossless = (small == cells).all()
                    blocks.append((small if lossless else cells).tobytes())
                kinds = table.column(0).type, pa.int32(), pa.binary()
                arrays = [pa.array(values, kind) for values, kind in zip((keys, counts, blocks), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [by, "_rows", "_cells"])

        fields = [T.StructField("_rows", T.IntegerType()), T.StructField("_cells", T.BinaryType())]
        self.table = plain.mapInArrow(pack, T.StructType([self.kind, *fields])).persist(StorageLevel.MEMORY_AND_DISK)

    def read(
        self,
        look: Callable[[Any, np.ndarray], Iterator[tuple[int, Any]]],
        join: Callable[[Any, Any], Any],
        end: Callable[[Any, int, Any], Any] = lambda batch, start, state: state,
        only: set | None = None,
    ) -> dict[tuple[Any, int], Any]:
        """Read blocks once: ``look`` gives states by start, ``join`` makes one of two, ``end`` what is returned.

        States are joined in the order of the tasks, so that sums are the same each time.
        """
        by, wide = self.by, self.wide
        names = [by, "_start", "_part", "_state"]

        def rows(found: Sequence[tuple[Any, int, int, Any]], kind: pa.DataType) -> list[pa.Array]:
            keys, numbers, parts, states = zip(*found)
            packed = pa.array([pickle.dumps(state) for state in states], pa.binary())
            return [pa.array(keys, kind), pa.array(numbers, pa.int32()), pa.array(parts, pa.int32()), packed]

        def within(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, kind, part = {}, None, TaskContext.get().partitionId()
            for table in tables:
                kind = table.column(0).type
                for key, n, packed in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2)):
                    packed = packed.as_buffer()
                    cells = np.frombuffer(packed, "float32" if packed.size == 4 * wide * n else "float64")
                    for start, state in look(key, cells.reshape(wide, n).astype("float64")):
                        state = join(found[key, start], state) if (key, start) in found else state
                        found[key, start] = state
            for some in batched(found.items(), 64):
                yield pa.RecordBatch.from_arrays(rows([(*k, part, state) for k, state in some], kind), names)

        def across(table: pa.Table) -> pa.Table:
            key, start = table[by][0].as_py(), table["_start"][0].as_py()
            ordered = table.sort_by("_part")["_state"]
            state = end(key, start, reduce(join, (pickle.loads(packed.as_buffer()) for packed in ordered)))
            return pa.Table.from_arrays(rows([(key, start, 0, state)], table.schema.field(by).type), names)

        integers = [T.StructField(name, T.IntegerType()) for name in names[1:3]]
        schema = T.StructType([self.kind, *integers, T.StructField("_state", T.BinaryType())])
        table = self.table
        if only is not None and len(only) <= FEW_BATCHES:
            table = table.where(F.col(by).isin(list(only)))
        partial = table.mapInArrow(within, schema)
        joined = partial.groupBy(by, "_start").applyInArrow(across, schema)
        return {(row[0], row[1]): pickle.loads(row[3]) for row in joined.collect()}


def _centroids(blocks: _Blocks, steps: int | None, tolerance: float, starts: int) -> dict[Any, list[list[float]]]:
    """Of each batch the centroids that :func:`_cluster_one` would come to, by looks at all blocks."""
    pairwise = lambda join: lambda x, y: tuple(f(a, b) for f, a, b in zip(join, x, y))
    plus = lambda a, b: a + b
    summed = blocks.read(lambda _, x: [(0, (x.shape[1], x.sum(axis=1)))], pairwise([plus, plus]))
    means = {batch: total / n for (batch, _), (n, total) in summed.items()}
    spread = blocks.read(
        lambda k, x: [(0, (_farthest(x, means[k]), ((x - means[k][:, None]) ** 2).sum(axis=1)))], pairwise([min, plus])
    )
    variance = {batch: squares / summed[batch, 0][0] for (batch, _), (_, squares) in spread.items()}
    first = {batch: far[-1] for (batch, _), (far, _) in spread.items()}
    widest = {batch: _widest(v, starts) for batch, v in variance.items()}
    ends = blocks.read(
        lambda k, x: [(0, (_farthest(x, first[k]), *[f(x, c) for c in widest[k] for f in (_lowest, _highest)]))],
        pairwise([min, *[min, max] * (starts - 1)]),
    )
    pairs = {}
    for (batch, _), (far, *rest) in ends.items():
        rows = [first[batch], far[-1], *[row for _, row in rest]]
        pairs |= {(batch, i): _Pair(rows[2 * i : 2 * i + 2], 0.0, steps, steps == 0) for i in range(starts)}
    still = {batch: v.mean() * tolerance for batch, v in variance.items()}
    while active := {k: pair for k, pair in pairs.items() if not pair.settled}:
        pairs |= blocks.read(
            lambda k, x: [
                (i, _look(x, active[k, i].points, active[k, i].reach)) for i in range(starts) if (k, i) in active
            ],
            _Looked.joined,
            lambda k, i, looked: active[k, i].after(looked, still[k]),
            {k for k, _ in active},
        )
    settled = {k: pair.points for k, pair in pairs.items()}
    if starts > 1:
        inertia = blocks.read(lambda k, x: [(i, _inertia(x, settled[k, i])) for i in range(starts)], plus)
    else:
        inertia = dict.fromkeys(settled, 0.0)
    return {k: _best([(settled[k, i], inertia[k, i]) for i in range(starts)]) for k in means}


def _cluster_in_place(
    rows: DataFrame, columns: Sequence[str], by: str, steps: int | None, tolerance: float, starts: int, batches: int
) -> DataFrame:
    blocks = _Blocks(rows, columns, by, batches)
    points = _centroids(blocks, steps, tolerance, starts)
    blocks.table.unpersist()

    @F.arrow_udf(T.IntegerType())
    def cluster(batch: pa.Array, *columns: pa.Array) -> pa.Array:
        sides, missing = np.zeros(len(batch), dtype="int32"), np.ones(len(batch), dtype=bool)
        for key, places, cells in _by_batch(batch, columns):
            if key is not None:
                sides[places], missing[places] = _side(cells, points[key]), False
        return pa.array(sides, mask=missing)

    return rows.select(*rows.columns, cluster(by, *[F.col(c).cast("double") for c in columns]).alias("cluster"))


def two_means(
    rows: DataFrame,
    columns: Sequence[str],
    by: str = "batch_id",
    steps: int | None = None,
    tolerance: float = TOLERANCE,
    task_rows: int = TASK_ROWS,
    starts: int = 1,
) -> DataFrame:
    """Two clusters per batch, with ``cluster`` 0 or 1 numbered by ascending centroid.

    Starts are deterministic: the row farthest from the mean and the one farthest from that; with
    more ``starts`` also the lowest and highest row along the columns of largest variance. The
    start that ends with the least inertia wins, the earlier one of equal ones. A batch settles
    when its centroids shift by no more than ``tolerance`` times its mean variance, and takes no
    part in later steps; ``steps`` bounds them, a negative tolerance runs them all. A row with a
    missing feature has no cluster. ``rows`` are read three times; persist them where that costs more.
    """
    if steps is None and tolerance < 0:
        raise ValueError("a negative tolerance needs a number of steps")
    starts = min(starts, len(columns) + 1)
    missing = reduce(lambda x, y: x | y, [F.col(c).isNull() | F.isnan(c) for c in columns])
    largest, batches = rows.groupBy(by).count().agg(F.max("count"), F.count("*")).first()
    if (largest or 0) > task_rows:  # a row without a batch has no centroids here
        rows = rows.where(F.col(by).isNotNull() | missing)
        return _cluster_in_place(rows, columns, by, steps, tolerance, starts, batches)
    found = _cluster_in_tasks(rows.where(~missing), columns, by, steps, tolerance, starts)
    return found.unionByName(rows.where(missing).withColumn("cluster", F.lit(None).cast("int")))
