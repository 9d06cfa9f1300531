"""How well a clustering agrees with the concepts, from a two-by-two table of counts.

All metrics are expressions on the counts ``c00, c01, c10, c11`` (concept, cluster), so the
rows themselves are grouped once, whatever the number of metrics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.special import log_factorial_sql

CELLS = ["c00", "c01", "c10", "c11"]
# The metric names of a prediction log.
METRICS = [
    "accuracy_score", "homogeneity_score", "completeness_score", "v_measure_score",
    "adjusted_rand_score", "adjusted_mutual_info_score",
]


def contingency(
    rows: DataFrame, by: Sequence[str], concept: str = "concept", cluster: str = "cluster"
) -> DataFrame:
    """Counts of (concept, cluster) pairs per group, as four columns."""
    cells = [
        F.expr(f"count_if({concept} = {cell[1]} AND {cluster} = {cell[2]})").alias(cell) for cell in CELLS
    ]
    return rows.groupBy(*by).agg(*cells)


def _entropy(*parts: str) -> str:
    return " ".join(f"- CASE WHEN {p} > 0 THEN {p} / _n * ln({p} / _n) ELSE 0D END" for p in parts)


def _pairs(*counts: str) -> str:
    return "(" + " + ".join(f"{c} * ({c} - 1D) / 2" for c in counts) + ")"


# Columns added on the way start with an underscore, so that they cannot meet a group key.
_SIDES = {"_a0": "c00 + c01", "_a1": "c10 + c11", "_b0": "c00 + c10", "_b1": "c01 + c11"}
_CROSS = [("_a0", "_b0", "c00"), ("_a0", "_b1", "c01"), ("_a1", "_b0", "c10"), ("_a1", "_b1", "c11")]


#: A user's metric: an expression on the four counts, as a column or as SQL text.
Metric = Column | str


def agreement(table: DataFrame, by: Sequence[str], metrics: Mapping[str, Metric] | None = None) -> DataFrame:
    """The agreement metrics of every group of :func:`contingency`.

    ``metrics`` adds more of them by name, each an expression on the counts ``c00`` to ``c11``.
    They cost no further pass over rows, and go through the detectors like the others.
    """
    by = list(by)
    found = _agreement(table, by)
    if not metrics:
        return found
    clash = set(metrics) & {*METRICS, *by}
    if clash:
        raise ValueError(f"names in use: {sorted(clash)}")
    own = [(F.expr(m) if isinstance(m, str) else m).cast("double").alias(name) for name, m in metrics.items()]
    return found.join(table.select(*by, *own), by)


def _agreement(table: DataFrame, by: list[str]) -> DataFrame:
    mutual = " + ".join(
        f"CASE WHEN {c} > 0 THEN {c} / _n * (ln(_n) + ln({c}) - ln({a}) - ln({b})) ELSE 0D END"
        for a, b, c in _CROSS
    )
    sides = [f"CAST({text} AS double) AS {name}" for name, text in _SIDES.items()]
    base = (
        table.selectExpr(*by, *CELLS, *sides, "CAST(c00 + c01 + c10 + c11 AS double) AS _n")
        .selectExpr(
            "*", f"{_entropy('_a0', '_a1')} AS _hc", f"{_entropy('_b0', '_b1')} AS _hk",
            f"greatest({mutual}, 0D) AS _mi",
        )
    )
    rows, columns = _pairs("_a0", "_a1"), _pairs("_b0", "_b1")
    single = "((_hc = 0 AND _hk = 0) OR _n <= 1)"
    return (
        base.join(expected_mutual_info(base, by), by, "left")
        .selectExpr(
            *by, "(c00 + c11) / _n AS _acc", "_hc", "_hk", "_mi", "coalesce(_emi, 0D) AS _emi", "_n",
            "CASE WHEN _hc = 0 THEN 1D ELSE try_divide(_mi, _hc) END AS _hom",
            "CASE WHEN _hk = 0 THEN 1D ELSE try_divide(_mi, _hk) END AS _com",
            f"{_pairs(*CELLS)} AS _together", f"({rows} + {columns}) / 2 AS _most",
            f"try_divide({rows} * {columns}, {_pairs('_n')}) AS _chance",
        )
        .selectExpr(
            *by,
            f"_acc AS {METRICS[0]}",
            f"_hom AS {METRICS[1]}",
            f"_com AS {METRICS[2]}",
            f"CASE WHEN _hom + _com = 0 THEN 0D ELSE 2 * _hom * _com / (_hom + _com) END AS {METRICS[3]}",
            f"CASE WHEN {single} THEN 1D ELSE coalesce(try_divide(_together - _chance, _most - _chance), 1D) END"
            f" AS {METRICS[4]}",
            # no room above chance: the ratio would be rounding noise
            f"CASE WHEN {single} THEN 1D WHEN abs((_hc + _hk) / 2 - _emi) < 1e-12D THEN 0D"
            f" ELSE (_mi - _emi) / ((_hc + _hk) / 2 - _emi) END AS {METRICS[5]}",
        )
    )


def expected_mutual_info(base: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mutual information expected by chance (Vinh et al. 2010): a hypergeometric sum per cell.

    The terms of a cell lie within ``[max(1, a+b-n), min(a,b)]``. By Hoeffding's bound those
    further than 19 square roots of ``min(a,b)`` from the mean weigh less than 1e-300 and
    vanish in a double, so a cell takes that many terms and not one per row of the batch.
    """
    pairs = ", ".join(f"struct({a} AS _a, {b} AS _b)" for a, b, _ in _CROSS)
    reach, middle = "(ceil(19 * sqrt(least(_a, _b))) + 1)", "floor(_a * _b / _n)"
    low = f"greatest(1L, CAST(_a + _b - _n AS long), {middle} - {reach})"
    high = f"least(CAST(least(_a, _b) AS long), {middle} + {reach})"
    up = ["_a", "_b", "(_n - _a)", "(_n - _b)"]
    down = ["_n", "_k", "(_a - _k)", "(_b - _k)", "(_n - _a - _b + _k)"]
    weight = " + ".join(map(log_factorial_sql, up)) + "".join(f" - {log_factorial_sql(x)}" for x in down)
    term = f"_k / _n * (ln(_n) + ln(_k) - ln(_a) - ln(_b)) * exp({weight})"
    return (
        base.selectExpr(*by, "_n", f"inline(array({pairs}))")
        .filter("_a > 0 AND _b > 0")
        .selectExpr(*by, "_n", "_a", "_b", f"explode(sequence({low}, {high})) AS _k")
        .groupBy(*by).agg(F.expr(f"sum({term}) AS _emi"))
    )


def long_metrics(metrics: DataFrame, by: Sequence[str], names: Sequence[str] = ()) -> DataFrame:
    """One row per group and metric: the six, and those of further ``names``."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in [*METRICS, *names]]
    return metrics.select(*by, F.inline(F.array(*pairs)))
