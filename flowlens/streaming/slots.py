"""Inter-arrival times on a stream: instants wait in keyed state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from flowlens.streaming.keyed import OrderedBuffer

#: Packets of one address at one instant. ``lens`` counts those with a length.
INSTANT = np.dtype([(n, "<i8") for n in ("at", "n", "lens", "len_sum", "len_sq", "len_min", "len_max")])
LARGE = np.iinfo(np.int64).max

SLOT_COLUMNS = (
    "pane bigint, slot bigint, n bigint, len_n bigint, len_sum bigint, len_sq bigint, len_min int, len_max int, "
    "first bigint, last bigint, gap_min bigint, gap_max bigint, gap_sq bigint"
)


def merged(rows: np.ndarray) -> np.ndarray:
    """Rows in order of time, those of one instant made into one."""
    rows = rows[np.argsort(rows["at"], kind="stable")]
    new = np.ones(len(rows), bool)
    new[1:] = rows["at"][1:] != rows["at"][:-1]
    if new.all():
        return rows
    begins = np.nonzero(new)[0]
    out = np.empty(len(begins), INSTANT)
    out["at"] = rows["at"][begins]
    for name in ("n", "lens", "len_sum", "len_sq"):
        out[name] = np.add.reduceat(rows[name], begins)
    out["len_min"] = np.minimum.reduceat(rows["len_min"], begins)
    out["len_max"] = np.maximum.reduceat(rows["len_max"], begins)
    return out


def instants(packets: pd.DataFrame) -> np.ndarray:
    """One instant per packet, from the columns ``rel`` and ``frame_len`` (may be missing)."""
    out = np.empty(len(packets), INSTANT)
    known = packets["frame_len"].notna().to_numpy()
    length = packets["frame_len"].fillna(0).to_numpy().astype(np.int64)
    out["at"] = packets["rel"].to_numpy()
    out["n"], out["lens"], out["len_sum"], out["len_sq"] = 1, known, length, length * length
    out["len_min"], out["len_max"] = np.where(known, length, LARGE), np.where(known, length, -LARGE)
    return out


class Summary:
    """Sums of one slot while its instants pass by in order."""

    def __init__(self) -> None:
        self.n = self.lens = self.len_sum = self.len_sq = self.gap_sq = 0
        self.len_min, self.len_max, self.gap_min, self.gap_max = LARGE, -LARGE, None, None
        self.first = self.last = None

    def add(self, rows: np.ndarray) -> None:
        self.n += int(rows["n"].sum())
        self.lens += int(rows["lens"].sum())
        self.len_sum += int(rows["len_sum"].sum())
        self.len_sq += int(rows["len_sq"].sum())
        self.len_min = min(self.len_min, int(rows["len_min"].min()))
        self.len_max = max(self.len_max, int(rows["len_max"].max()))
        at = rows["at"] if self.last is None else np.concatenate([[self.last], rows["at"]])
        gaps = np.diff(at)
        if (rows["n"] > 1).any():  # packets of one instant: no time between them
            self.gap_min, self.gap_max = 0, self.gap_max or 0
        if len(gaps):
            least, most = int(gaps.min()), int(gaps.max())
            self.gap_min = least if self.gap_min is None else min(self.gap_min, least)
            self.gap_max = most if self.gap_max is None else max(self.gap_max, most)
            self.gap_sq += int((gaps * gaps).sum())
        self.first = int(at[0]) if self.first is None else self.first
        self.last = int(at[-1])

    def row(self, pane: int, slot: int) -> tuple:
        sizes = (self.len_sum, self.len_sq, self.len_min, self.len_max) if self.lens else (None,) * 4
        return (
            self.first // pane, self.first % pane // slot, self.n, self.lens, *sizes,
            self.first, self.last, self.gap_min, self.gap_max, self.gap_sq,
        )


class SlotBuffer(StatefulProcessor):
    """Summaries of the slots of one address, each made when the watermark has passed the slot.

    The key is (role, address, block of time). Packets come in any order and wait as instants in
    an ordered buffer; summaries fold one leaf of it after the other, so no step holds the
    instants of a slot together. Blocks spread a flooding address over keys.
    """

    def __init__(self, anchor: int, pane: int, slot: int) -> None:
        self.anchor, self.pane, self.slot = anchor, pane, slot

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = OrderedBuffer(handle, INSTANT, merged)

    def _closes(self, at: int) -> int:
        """The watermark, in milliseconds, from which on all packets of the slot of ``at`` are late."""
        return -(-(self.anchor + (at // self.slot + 1) * self.slot) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        low, high = [], []
        for packets in rows:
            if len(packets):
                low.append(int(packets["rel"].min()))
                high.append(int(packets["rel"].max()))
                self.buffer.add(instants(packets))
        if low:
            for timer in {self._closes(min(low)), self._closes(max(high))}:
                self.handle.registerTimer(timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = (timerValues.getCurrentWatermarkInMs() * 1000 - self.anchor) // self.slot * self.slot
        now, number, out = None, None, []
        for leaf in self.buffer.taken(lambda rows: int(np.searchsorted(rows["at"], passed))):
            numbers = leaf["at"] // self.slot
            cuts = [0, *(np.nonzero(numbers[1:] != numbers[:-1])[0] + 1).tolist(), len(leaf)]
            for begin, end in zip(cuts[:-1], cuts[1:]):
                if numbers[begin] != number:
                    if now is not None:
                        out.append((*key[:2], *now.row(self.pane, self.slot)))
                    now, number = Summary(), numbers[begin]
                now.add(leaf[begin:end])
            if len(out) > 4096:
                yield self._table(out)
                out = []
        if now is not None:
            out.append((*key[:2], *now.row(self.pane, self.slot)))
            yield self._table(out)

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        names = ["role", "IP", *[c.split()[0] for c in SLOT_COLUMNS.split(", ")]]
        missing = ("len_sum", "len_sq", "len_min", "len_max", "gap_min", "gap_max")
        return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in missing})
