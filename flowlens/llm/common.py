"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a worker keeps from one task to the next: vocabularies and a tokenizer's answers.
_KEPT: dict[tuple, object] = {}


def kept_in_worker(key: tuple, make: Callable[[], object]):
    """The object of ``key``, made once per worker; those of other keys are let go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def leave_nothing_kept() -> None:
    """Let go what tasks of an earlier stage kept in this worker, and give the memory back."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def complete_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from the batches of a partition sorted by ``keys``.

    The rows of the last, perhaps unfinished, group wait for the next batch.
    """
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        cuts = boundaries(rows, keys)
        same = waiting and all(
            waiting[-1].column(k)[-1].as_py() == rows.column(k)[0].as_py() for k in keys
        )
        if waiting and not same:
            yield pa.concat_tables(waiting)
            waiting = []
        last = int(cuts[-1])
        if last:
            yield pa.concat_tables([*waiting, rows.slice(0, last)])
            waiting = []
        waiting.append(rows.slice(last))
    if waiting:
        yield pa.concat_tables(waiting)


def boundaries(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a new group begins in rows sorted by ``keys``."""
    new = np.zeros(rows.num_rows, bool)
    if rows.num_rows:
        new[0] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.nonzero(new)[0]


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A column of arrays of one length as a two-dimensional array."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 0), dtype)


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite in every component and not zero."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))),
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def text_batches(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the offsets of its rows (null: empty)."""
    array = batch.column(column)
    kind = pa.large_binary()
    array = array.cast(pa.large_string()).cast(kind) if not pa.types.is_binary(array.type) else array.cast(kind)
    array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(array) else raw[:0], offsets - offsets[0]


#: Steps of the 64-bit finalizer that spreads the bits of a polynomial hash.
def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of the polynomial hash, and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hash`` takes the hash of any range of ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0], out=out[1:])
    return out


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of ranges of the values that ``sums`` were made from."""
    down = powers(len(sums))[1]
    return mixed((sums[end] - sums[begin]) * down[begin])
