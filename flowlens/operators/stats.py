"""Packet statistics per window and address.

Overlapping windows share their work. Packets are reduced once to *slots* (short slices of
one address's traffic), slots to *panes* (slices that never straddle a window border), and
panes are merged into windows. Every level carries sums that merge exactly: counts and
integer sums, and for gaps also the first and last time, so the gap between two
neighbouring slices is known.

Skew: no step gathers all packets of one address. Packets with the same address and time
are counted map-side first; the ordered step runs per (address, slot) and holds at most one
row per distinct microsecond of a slot. Only slot summaries are ordered per address, and per
block of time when there can be more than ``MAX_SLOTS`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timerange import in_time_range, micros_sql
from flowlens.operators.windows import WindowGrid, assign_windows

ROLES = ("Source", "Destination")
PREFIX = {"Source": "S", "Destination": "R"}
DEFAULT_SLOT = 60_000_000
# Gaps inside a slot add up to at most its width, so their squares add up to at most the
# width squared. Below 3,000 seconds that fits a long.
WIDEST_SLOT = 3_000_000_000
MAX_SLOTS = 1_000_000


def slot_width(grid: WindowGrid, slot: int = DEFAULT_SLOT) -> int:
    """Slot width in microseconds: never wider than a pane, and few enough slots per address."""
    span = max(grid.end - grid.anchor, 1)
    return min(max(slot, -(-span // MAX_SLOTS)), grid.pane, WIDEST_SLOT)


BIG = "decimal(38,0)"


def _add(value: str) -> str:
    """Exact sum of integers that may outgrow a long, as SQL text."""
    return f"CAST(sum(CAST({value} AS {BIG})) AS {BIG})"


def _square(value: str) -> str:
    return f"CAST({value} AS decimal(19,0)) * CAST({value} AS decimal(19,0))"


def _aggregates(**named: str) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in named.items()]


def positions(packets: DataFrame, grid: WindowGrid) -> DataFrame:
    """Packets that fall into a window, with ``rel``: microseconds after the anchor."""
    inside = in_time_range(packets, grid.anchor, grid.end, include_upper=False)
    placed = inside.selectExpr(
        f"{micros_sql('parsed_time')} - {grid.anchor} AS rel", "Source", "Destination", "frame_len"
    )
    if grid.offset > grid.size:
        placed = placed.filter(f"pmod(rel, {grid.offset}) < {grid.size}")
    return placed


def slot_stats(placed: DataFrame, pane: int, slot: int, roles: Sequence[str] = ROLES) -> DataFrame:
    """One row per (role, address, pane, slot): packet sums, first and last time, gaps inside.

    ``role`` is the position in ``ROLES``.
    """
    sides = ", ".join(f"struct({ROLES.index(role)} AS role, {role} AS IP)" for role in roles)
    return (
        placed.selectExpr("rel", "frame_len", f"inline(array({sides}))")
        # packets of one address at one instant: only a zero gap between each two
        .groupBy("role", "IP", "rel")
        .agg(*_aggregates(
            n="count(*)",
            len_n="count(frame_len)",
            len_sum="sum(CAST(frame_len AS long))",
            len_sq="sum(CAST(frame_len AS long) * frame_len)",
            len_min="min(frame_len)",
            len_max="max(frame_len)",
        ))
        .selectExpr("*", f"rel div {pane} AS pane", f"rel % {pane} div {slot} AS slot")
        .selectExpr("*", "rel - lag(rel) OVER (PARTITION BY role, IP, pane, slot ORDER BY rel) AS gap")
        .groupBy("role", "IP", "pane", "slot")
        .agg(*_aggregates(
            n="sum(n)",
            len_n="sum(len_n)",
            len_sum="sum(len_sum)",
            len_sq="sum(len_sq)",
            len_min="min(len_min)",
            len_max="max(len_max)",
            first="min(rel)",
            last="max(rel)",
            gap_min="min(CASE WHEN n > 1 THEN 0L ELSE gap END)",
            gap_max="max(coalesce(gap, CASE WHEN n > 1 THEN 0L END))",
            gap_sq="sum(coalesce(gap * gap, 0L))",
        ))
    )


def _with_before(slots: DataFrame, grid: WindowGrid, slot: int) -> tuple[DataFrame, list[str]]:
    """Slots with ``before``, the address's last time in an earlier slot, and the keys they are
    partitioned by. A slot is one row whatever it counted."""
    per_pane = -(-grid.pane // slot)
    panes = -(-(grid.end - grid.anchor) // grid.pane)
    if panes * per_pane <= MAX_SLOTS:
        lag = "lag(last) OVER (PARTITION BY role, IP ORDER BY pane, slot) AS before"
        return slots.selectExpr("*", lag), ["role", "IP"]
    keys = ["role", "IP", "block"]
    blocked = slots.selectExpr("*", f"pane div {max(MAX_SLOTS // per_pane, 1)} AS block")
    carried = blocked.groupBy(*keys).agg(F.expr("max(last) AS last")).selectExpr(
        *keys, "lag(last) OVER (PARTITION BY role, IP ORDER BY block) AS carried"
    )
    lag = "lag(last) OVER (PARTITION BY role, IP, block ORDER BY pane, slot) AS within"
    joined = blocked.selectExpr("*", lag).join(carried, keys)
    return joined.withColumn("before", F.coalesce("within", "carried")), keys


def pane_stats(slots: DataFrame, grid: WindowGrid, slot: int = DEFAULT_SLOT) -> DataFrame:
    """Slots merged per pane. ``prev`` is the address's last time before the pane, if any."""
    pane = grid.pane
    ordered, keys = _with_before(slots, grid, slot)
    inside = f"before >= pane * {pane}"
    gap = f"CASE WHEN {inside} THEN first - before END"
    return (
        ordered
        .groupBy(*keys, "pane")
        .agg(*_aggregates(
            n="sum(n)",
            len_n="sum(len_n)",
            len_sum="sum(len_sum)",
            len_sq=_add("len_sq"),
            len_min="min(len_min)",
            len_max="max(len_max)",
            first="min(first)",
            last="max(last)",
            gap_min=f"min(least(gap_min, {gap}))",
            gap_max=f"max(greatest(gap_max, {gap}))",
            gap_sq=_add(f"(gap_sq + coalesce({_square(f'({gap})')}, 0))"),
            prev=f"min(CASE WHEN NOT {inside} THEN before END)",
        ))
    )


def _spread(n: str, total: str, squares: str) -> str:
    """Sample standard deviation from exact sums, as SQL text; null for a single value."""
    moment = f"CAST(CAST({n} AS decimal(19,0)) * {squares} - {_square(total)} AS double)"
    return f"CASE WHEN {n} > 1 THEN sqrt(greatest({moment}, 0D) / (CAST({n} AS double) * ({n} - 1))) END"


def window_stats(panes: DataFrame, grid: WindowGrid, roles: Sequence[str] = ROLES) -> DataFrame:
    """Panes merged per window: one row per (window, address) with the metrics of each role.

    Both roles come out of one grouping, which does the work of an outer join of two tables.
    """
    gap = f"CASE WHEN prev >= window_index * {grid.offset} THEN first - prev END"
    spread_panes = panes.select(
        "*", F.explode(grid.windows_at(f"pane * {grid.pane}")).alias("window_index")
    ).selectExpr(
        "window_index", "role", "IP", "n", "len_n", "len_sum", "len_sq", "len_min", "len_max", "first", "last",
        f"least(gap_min, {gap}) AS gap_min",
        f"greatest(gap_max, {gap}) AS gap_max",
        f"CAST(gap_sq + coalesce({_square(f'({gap})')}, 0) AS {BIG}) AS gap_sq",
    )
    sums, metrics = {}, []
    for role in roles:
        tag = PREFIX[role]

        def of(name: str, role: str = role) -> str:
            return name if len(roles) == 1 else f"CASE WHEN role = {ROLES.index(role)} THEN {name} END"

        sums |= {
            f"{tag}_n": f"sum({of('n')})",
            f"{tag}_lens": f"sum({of('len_n')})",
            f"{tag}_len": f"sum({of('len_sum')})",
            f"{tag}_sq": _add(of("len_sq")),
            f"{tag}_min": f"min({of('len_min')})",
            f"{tag}_max": f"max({of('len_max')})",
            f"{tag}_first": f"min({of('first')})",
            f"{tag}_last": f"max({of('last')})",
            f"{tag}_gmin": f"min({of('gap_min')})",
            f"{tag}_gmax": f"max({of('gap_max')})",
            f"{tag}_gsq": _add(of("gap_sq")),
        }
        metrics += _role_metrics(role)
    merged = spread_panes.groupBy("window_index", "IP").agg(*_aggregates(**sums))
    return merged.selectExpr("window_index", "IP", *metrics)


def _role_metrics(role: str) -> list[str]:
    tag = PREFIX[role]
    n, lens, total, gaps = f"{tag}_n", f"{tag}_lens", f"{tag}_len", f"({tag}_n - 1)"
    waited = f"({tag}_last - {tag}_first)"
    gap = [
        f"{tag}_gmin / 1e6D AS {tag}ITmin",
        f"{tag}_gmax / 1e6D AS {tag}ITmax",
        f"CASE WHEN {gaps} > 0 THEN {waited} / {gaps} / 1e6D END AS {tag}ITavg",
        f"{_spread(gaps, waited, f'{tag}_gsq')} / 1e6D AS {tag}ITvar",
    ]
    # packets without a length count as packets, but play no part in the sizes
    size = [f"try_divide({total}, {lens}) AS {tag}avg", f"{_spread(lens, total, f'{tag}_sq')} AS {tag}var"]
    if role == "Source":
        extremes = [f"{tag}_min AS Smin", f"{tag}_max AS Smax"]
        return [f"{n} AS Spc", f"{total} AS Tss", *extremes, *size, *gap]
    return [f"{n} AS Rpc", f"{total} AS Tsr", *size, *gap]


def packet_stats(
    packets: DataFrame, grid: WindowGrid, roles: Sequence[str] = ROLES, slot: int = DEFAULT_SLOT
) -> DataFrame:
    """Sender and receiver metrics of every (window, address), null where a side is missing."""
    width = slot_width(grid, slot)
    slots = slot_stats(positions(packets, grid), grid.pane, width, roles)
    return window_stats(pane_stats(slots, grid, width), grid, roles)


def source_metrics(packets: DataFrame, grid: WindowGrid) -> DataFrame:
    return packet_stats(packets, grid, ("Source",))


def destination_metrics(packets: DataFrame, grid: WindowGrid) -> DataFrame:
    return packet_stats(packets, grid, ("Destination",))


def edges(packets: DataFrame, grid: WindowGrid) -> DataFrame:
    """Packets per (window, sender, receiver), counted per pane first."""
    counted = (
        positions(packets, grid)
        .selectExpr(f"rel div {grid.pane} AS pane", "Source", "Destination")
        .groupBy("pane", "Source", "Destination")
        .agg(F.expr("count(*) AS `count`"))
        .select(
            F.explode(grid.windows_at(f"pane * {grid.pane}")).alias("window_index"),
            "Source", "Destination", "count",
        )
    )
    if grid.size == grid.pane:  # one pane per window: nothing left to merge
        return counted
    return counted.groupBy("window_index", "Source", "Destination").agg(F.expr("sum(`count`) AS `count`"))


def time_diff(packets: DataFrame, role: str, slot: int = DEFAULT_SLOT) -> DataFrame:
    """Packets with ``previous_us``, the time of the same address's packet before it.

    The lag runs per (address, slot); the first packet of a slot takes the last time of the
    slot before, which comes from a table of one row per slot.
    """
    placed = packets.selectExpr("*", f"{micros_sql('parsed_time')} AS at_us").selectExpr(
        "*", f"at_us div {slot} AS slot"
    )
    carried = placed.groupBy(role, "slot").agg(F.expr("max(at_us) AS last_us")).selectExpr(
        role, "slot", f"lag(last_us) OVER (PARTITION BY {role} ORDER BY slot) AS carried_us"
    )
    return (
        placed.selectExpr("*", f"lag(at_us) OVER (PARTITION BY {role}, slot ORDER BY at_us) AS inside_us")
        .join(carried, [role, "slot"])
        .selectExpr(*packets.columns, "at_us", "coalesce(inside_us, carried_us) AS previous_us")
    )


def window_time_diff(packets: DataFrame, grid: WindowGrid, role: str) -> DataFrame:
    """Per window and packet, seconds since the same address's previous packet in that window."""
    inside = in_time_range(packets, grid.anchor, grid.end, include_upper=False)
    seen = assign_windows(time_diff(inside, role), grid)
    start = f"window_index * {grid.offset} + {grid.anchor}"
    return seen.selectExpr(
        *packets.columns, "window_index",
        f"CASE WHEN previous_us >= {start} THEN (at_us - previous_us) / 1e6D END AS {role}_time_diff",
    )
