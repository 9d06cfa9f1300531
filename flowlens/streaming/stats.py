"""Window statistics on a packet stream, with a watermark for late packets."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timerange import instant, micros_of
from flowlens.operators.stats import ROLES
from flowlens.operators.windows import SECOND, WindowGrid
from flowlens.streaming.keyed import keyed_state
from flowlens.streaming.slots import SLOT_COLUMNS, SlotBuffer

STREAM_SLOT = SECOND
STREAM_BLOCK = 10 * SECOND


def _duration(micros: int) -> str:
    return f"{micros} microseconds"


def _sides(roles: Sequence[str] = ROLES) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(ROLES.index(r)).alias("role"), F.col(r).alias("IP")) for r in roles]))


def _late_after(packets: DataFrame, delay: str) -> DataFrame:
    """Packets with an event time that carries a watermark; rows that cannot be placed drop out."""
    kept = packets.where("Source IS NOT NULL AND Destination IS NOT NULL AND parsed_time IS NOT NULL")
    return kept.withColumn("parsed_time", F.col("parsed_time").cast("timestamp")).withWatermark("parsed_time", delay)


def _sliding(anchor: int, size: int, offset: int) -> Column:
    """Spark's own sliding window, shifted so that windows start at the anchor.

    Windows with gaps between them are as wide as their offset here; packets of the gaps must
    have been left out, see :func:`_within`.
    """
    return F.window("parsed_time", _duration(max(size, offset)), _duration(offset), _duration(anchor % offset))


def _within(packets: DataFrame, anchor: int, size: int, offset: int) -> DataFrame:
    """Packets that do not lie in a gap between windows."""
    if offset <= size:
        return packets
    return packets.where(F.pmod(micros_of("parsed_time") - anchor, F.lit(offset)) < size)


def _placed(closed: DataFrame, anchor: int, size: int, offset: int) -> DataFrame:
    """Windows that start at the anchor or later, with their index."""
    start = F.unix_micros(F.col("window.start"))
    return (
        closed.filter(F.col("window.start") >= instant(F.lit(anchor)))
        .withColumn("window_index", F.call_function("div", start - anchor, F.lit(offset)))
        .withColumns({"window_start": F.col("window.start"), "window_end": instant(start + size)})
        .drop("window")
    )


def stream_packet_stats(packets: DataFrame, anchor: int, size: int, offset: int, delay: str) -> DataFrame:
    """Packet size statistics of both roles per (window, address); a window comes out when it is closed."""
    source, length = F.col("role") == ROLES.index("Source"), F.col("frame_len").cast("long")
    sent, received = F.when(source, length), F.when(~source, length)
    inside = _within(_late_after(packets, delay), anchor, size, offset)
    rows = inside.select("parsed_time", "frame_len", _sides())
    closed = rows.groupBy(_sliding(anchor, size, offset), "IP").agg(
        F.count_if(source).alias("Spc"), F.sum(sent).alias("Tss"),
        F.min(sent).alias("Smin"), F.max(sent).alias("Smax"),
        F.avg(sent).alias("Savg"), F.stddev(sent).alias("Svar"),
        F.count_if(~source).alias("Rpc"), F.sum(received).alias("Tsr"),
        F.avg(received).alias("Ravg"), F.stddev(received).alias("Rvar"),
    )
    return _placed(closed, anchor, size, offset)


def stream_edges(packets: DataFrame, anchor: int, size: int, offset: int, delay: str) -> DataFrame:
    """Packets per (window, sender, receiver) of closed windows."""
    closed = _within(_late_after(packets, delay), anchor, size, offset).groupBy(
        _sliding(anchor, size, offset), "Source", "Destination"
    ).agg(F.count("*").alias("count"))
    return _placed(closed, anchor, size, offset)


def stream_slot(grid: WindowGrid, slot: int = STREAM_SLOT) -> int:
    """Slot width on a stream: it divides the pane, so that slots line up with the windows."""
    return gcd(grid.pane, slot)


def stream_slot_stats(
    packets: DataFrame, grid: WindowGrid, delay: str, slot: int = STREAM_SLOT, block: int = STREAM_BLOCK
) -> DataFrame:
    """Slot summaries on a stream, in the columns of the batch ones, gaps included.

    Written to a table, they go through the same ``pane_stats`` and ``window_stats`` as in
    batch. Packets wait in state keyed by (role, address, ``block`` of time) until the watermark
    has passed their slot, in any order; see :class:`flowlens.streaming.slots.SlotBuffer`. A
    packet older than the watermark is late and left out. Short blocks spread the packets of a
    flooding address, long ones make fewer keys of quiet addresses.
    """
    keyed_state(packets.sparkSession)
    slot = stream_slot(grid, slot)
    rows = _late_after(packets, delay).filter(F.col("parsed_time") >= instant(F.lit(grid.anchor))).select(
        "parsed_time", F.col("frame_len").cast("int").alias("frame_len"),
        (micros_of("parsed_time") - grid.anchor).alias("rel"), _sides(),
    )
    number = F.call_function("div", F.col("rel"), F.lit(-(-block // slot) * slot)).alias("block")
    return rows.select("*", number).groupBy("role", "IP", "block").transformWithStateInPandas(
        SlotBuffer(grid.anchor, grid.pane, slot), f"role int, IP string, {SLOT_COLUMNS}", "append", "eventTime"
    )
