"""Keyed state with event-time buffers: what the stateful operators of a stream share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Use the state store that ``transformWithState`` needs for streams of this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class OrderedBuffer:
    """Rows of one key in order of their field ``at``, in leaves of a bounded size.

    Leaves are values of a map state by number, each some rows in order; a value state lists
    where they begin, in order. Rows that arrive go into the leaf they belong to (into the first,
    if they lie before it), and a leaf that grows beyond ``most`` rows is split. So rows come in
    any order, go out in order, and one leaf at a time is in memory, however many rows wait.
    """

    LIST = np.dtype([("begin", "<i8"), ("leaf", "<i8")])

    def __init__(self, handle, kind: np.dtype, merge: Callable[[np.ndarray], np.ndarray], most: int = 4096) -> None:
        self.leaves = handle.getMapState("leaves", "leaf bigint", "packed binary")
        self.directory = handle.getValueState("directory", "leaves binary")
        self.kind, self.merge, self.most = kind, merge, most

    def _listed(self) -> list[tuple[int, int]]:
        return np.frombuffer(self.directory.get()[0], self.LIST).tolist() if self.directory.exists() else []

    def _list(self, leaves: list[tuple[int, int]]) -> None:
        if leaves:
            self.directory.update((np.array(leaves, self.LIST).tobytes(),))
        else:
            self.directory.clear()

    def add(self, rows: np.ndarray) -> None:
        """Add rows; ``merge`` puts rows in order and makes one row of those with equal ``at``."""
        rows = self.merge(rows)
        if not len(rows):
            return
        listed = self._listed()
        held, listed = bool(listed), listed or [(int(rows["at"][0]), 0)]
        free = max(leaf for _, leaf in listed) + 1
        place = np.searchsorted(np.array([begin for begin, _ in listed[1:]], np.int64), rows["at"], side="right")
        cuts = [0, *(np.nonzero(place[1:] != place[:-1])[0] + 1).tolist(), len(rows)]
        fresh: list[tuple[int, int, int]] = []  # behind which, where it begins, its number
        for low, high in zip(cuts[:-1], cuts[1:]):
            at = int(place[low])
            key, new = (listed[at][1],), rows[low:high]
            if held:
                new = self.merge(np.concatenate([np.frombuffer(self.leaves.getValue(key)[0], self.kind), new]))
            first, *others = np.array_split(new, -(-len(new) * 2 // self.most) if len(new) > self.most else 1)
            self.leaves.updateValue(key, (first.tobytes(),))
            for part in others:
                fresh.append((at, int(part["at"][0]), free))
                self.leaves.updateValue((free,), (part.tobytes(),))
                free += 1
        if fresh or not held:
            inserted = [(at, -1, *leaf) for at, leaf in enumerate(listed)] + [(at, n, b, x) for n, (at, b, x) in enumerate(fresh)]
            self._list([(begin, leaf) for _, _, begin, leaf in sorted(inserted)])

    def taken(self, ready: Callable[[np.ndarray], int] = len) -> Iterator[np.ndarray]:
        """Take rows out in order, one leaf at a time, up to the first that is not ready.

        ``ready`` tells how many of the first rows of a leaf may go.
        """
        listed, gone = self._listed(), 0
        for _, leaf in listed:
            rows = np.frombuffer(self.leaves.getValue((leaf,))[0], self.kind)
            n = ready(rows)
            if n == len(rows):
                self.leaves.removeKey((leaf,))
                gone += 1
            elif n:
                self.leaves.updateValue((leaf,), (rows[n:].tobytes(),))
            if n:
                yield rows[:n]
            if n < len(rows):
                break
        if gone:
            self._list(listed[gone:])


def one_each(rows: np.ndarray) -> np.ndarray:
    """Rows in order of ``at``, of those with equal ``at`` the first."""
    rows = rows[np.argsort(rows["at"], kind="stable")]
    new = np.ones(len(rows), bool)
    new[1:] = rows["at"][1:] != rows["at"][:-1]
    return rows[new]
