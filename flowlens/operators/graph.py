"""Metrics of the who-talks-to-whom graph, for all windows in one job.

Degrees are plain groupings. The two centralities work on whole graphs, and a graph can be
small or huge, so each has two exact ways:

* windows of at most ``task_edges`` edges go to tasks as a whole, in one shuffle, and the
  betweenness of one window is spread over several tasks by source node;
* larger windows run as joins over (window, source, node) rows, one graph level per step,
  with the adjacency of busy senders split by salt.

Both results are exact. No node, edge or source is sampled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.durable import durable

TASK_EDGES = 100_000
# How many (edge, source) pairs one task handles at a time and in all.
TASK_PAIRS = 200_000_000
STEP_PAIRS = 2_000_000
SALT_DEGREE = 10_000
STATE_ROWS = 1_000_000_000

WINDOW = "window_index"
MAX_STEPS = 100
TOLERANCE = 1e-6


def nodes(edges: DataFrame) -> DataFrame:
    """All senders and receivers of every window, once each."""
    return edges.selectExpr(WINDOW, "explode(array(Source, Destination)) AS IP").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct senders to and distinct receivers from every node; a self-loop counts in both."""
    ends = "inline(array(struct(Source AS IP, 0 AS i, 1 AS o), struct(Destination AS IP, 1 AS i, 0 AS o)))"
    return edges.selectExpr(WINDOW, ends).groupBy(WINDOW, "IP").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")
    )


# --- windows that fit a task -------------------------------------------------------------


def _dependencies(first: np.ndarray, to: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray:
    """Brandes' dependency of some sources on every node, for all sources side by side.

    ``to[first[v]:first[v + 1]]`` are the receivers of node v. A cell ``row * n + v`` stands for
    node v as seen from one source; a step takes the cells of one level to the next along the
    edges that reach new cells, and these edges are all that the way back needs.
    """
    origins = np.arange(len(sources)) * n + sources
    seen, paths = np.zeros(len(sources) * n, dtype=bool), np.zeros(len(sources) * n)
    seen[origins], paths[origins] = True, 1.0
    level, links = origins, []
    while len(level):
        node = level % n
        out = first[node + 1] - first[node]
        parent = np.repeat(level, out)
        edge = np.arange(len(parent)) + np.repeat(first[node] - (np.cumsum(out) - out), out)
        child = np.repeat(level - node, out) + to[edge]
        fresh = ~seen[child]
        parent, child = parent[fresh], child[fresh]
        level, back = np.unique(child, return_inverse=True)
        seen[level] = True
        paths[level] = np.bincount(back, weights=paths[parent], minlength=len(level))
        links.append((parent, child))
    share = np.zeros(len(paths))
    for parent, child in reversed(links):
        np.add.at(share, parent, paths[parent] / paths[child] * (1.0 + share[child]))
    share[origins] = 0.0
    return share.reshape(len(sources), n).sum(axis=0)


def _power_iteration(src: np.ndarray, dst: np.ndarray, n: int, steps: int, tolerance: float) -> np.ndarray:
    """Eigenvector centrality over incoming edges; zeros when it does not settle in time."""
    x = np.full(n, 1.0 / n)
    for _ in range(steps):
        last = x
        x = last + np.bincount(dst, weights=last[src], minlength=n)
        x = x / (np.sqrt((x * x).sum()) or 1.0)
        if np.abs(x - last).sum() < n * tolerance:
            return x
    return np.zeros(n)


def _graph_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, names = pd.factorize(pd.concat([pdf["Source"], pdf["Destination"]]), sort=True)
    return codes[: len(pdf)], codes[len(pdf):], np.asarray(names)


def _task_centralities(measures: tuple[str, ...], steps: int, tolerance: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst, names = _graph_of(pdf)
        n = len(names)
        part, parts = int(pdf["part"].iloc[0]), int(pdf["parts"].iloc[0])
        out = pd.DataFrame({WINDOW: pdf[WINDOW].iloc[0], "IP": names})
        between = np.zeros(n)
        if "centrality" in measures and n > 2:
            linked = src != dst
            order = np.argsort(src[linked], kind="stable")
            to = dst[linked][order]
            first = np.searchsorted(src[linked][order], np.arange(n + 1))
            senders = np.flatnonzero(np.diff(first))  # a node without receivers adds nothing
            mine = senders[part::parts]
            step = max(1, STEP_PAIRS // max(len(to), n))
            for at in range(0, len(mine), step):
                between += _dependencies(first, to, n, mine[at:at + step])
            between /= (n - 1) * (n - 2)
        out["centrality"] = between
        first_part = "eigenvector_centrality" in measures and part == 0
        out["eigenvector_centrality"] = (
            _power_iteration(src, dst, n, steps, tolerance) if first_part else 0.0
        )
        return out

    return run


def _centralities_in_tasks(
    edges: DataFrame, measures: tuple[str, ...], steps: int, tolerance: float
) -> DataFrame:
    """``edges`` carries ``parts``, the number of tasks its window is spread over."""
    spread = edges.select(
        WINDOW, "Source", "Destination", "parts",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    partial = spread.groupBy(WINDOW, "part").applyInPandas(
        _task_centralities(measures, steps, tolerance),
        f"{WINDOW} long, IP string, centrality double, eigenvector_centrality double",
    )
    return partial.groupBy(WINDOW, "IP").agg(*[F.sum(name).alias(name) for name in measures])


# --- windows beyond a task ---------------------------------------------------------------


def _salted(edges: DataFrame, per_salt: int) -> DataFrame:
    """Edges with ``salt``, which splits the receivers of a busy sender, and with the number
    of salts at both ends, so that rows at a node know which slices to visit."""
    out = edges.groupBy(WINDOW, F.col("Source").alias("node")).agg(F.count("*").alias("d"))
    salts = out.select(WINDOW, "node", F.ceil(F.col("d") / per_salt).cast("int").alias("salts"))
    here = salts.withColumnRenamed("node", "Source").withColumnRenamed("salts", "src_salts")
    there = salts.withColumnRenamed("node", "Destination").withColumnRenamed("salts", "dst_salts")
    return (
        edges.join(here, [WINDOW, "Source"])
        .join(there, [WINDOW, "Destination"], "left")
        .select(
            WINDOW, "Source", "Destination", "src_salts",
            F.coalesce("dst_salts", F.lit(0)).alias("dst_salts"),
            F.pmod(F.xxhash64("Destination"), F.col("src_salts")).cast("int").alias("salt"),
        )
    )


def _visit(rows: DataFrame) -> DataFrame:
    """Rows at a node, once per slice of its adjacency; nodes without receivers drop out."""
    return rows.filter("salts > 0").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    )


def _betweenness_by_joins(edges: DataFrame, per_salt: int, state_rows: int) -> DataFrame:
    """Betweenness of large windows; sources go through in blocks, so the state stays bounded."""
    graph = durable(_salted(edges.filter("Source <> Destination"), per_salt))
    sizes = nodes(edges).groupBy(WINDOW).agg(F.count("*").alias("n"))
    state = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    blocks = max(1, int(-(-state // state_rows)))
    total = None
    for block in range(blocks):
        part = durable(_block_dependencies(graph, block, blocks))
        total = part if total is None else durable(
            total.unionByName(part).groupBy(WINDOW, "IP").agg(F.sum("share").alias("share"))
        )
    n = F.col("n").cast("double")
    return (
        nodes(edges).join(sizes, WINDOW).join(total, [WINDOW, "IP"], "left")
        .select(
            WINDOW, "IP",
            F.when(F.col("n") > 2, F.coalesce("share", F.lit(0.0)) / ((n - 1) * (n - 2)))
            .otherwise(F.lit(0.0)).alias("centrality"),
        )
    )


def _block_dependencies(graph: DataFrame, block: int, blocks: int) -> DataFrame:
    state = [WINDOW, "origin", "node"]
    frontier = (
        graph.filter(F.pmod(F.xxhash64("Source"), F.lit(blocks)) == block)
        .select(
            WINDOW, F.col("Source").alias("origin"), F.col("Source").alias("node"),
            F.lit(1.0).alias("paths"), F.col("src_salts").alias("salts"),
        )
        .distinct()
    )
    links = graph.select(WINDOW, F.col("Source").alias("node"), "salt", "Destination", "dst_salts")
    levels = [durable(frontier)]
    visited = levels[0].select(*state)
    while True:
        reached = (
            _visit(levels[-1]).join(links, [WINDOW, "node", "salt"])
            .groupBy(WINDOW, "origin", F.col("Destination").alias("node"))
            .agg(F.sum("paths").alias("paths"), F.max("dst_salts").alias("salts"))
            .join(visited, state, "left_anti")
        )
        level = durable(reached)
        if level.isEmpty():
            break
        levels.append(level)
        visited = durable(visited.unionByName(level.select(*state)))
    schema = f"{WINDOW} long, origin string, node string, share double"
    share = graph.sparkSession.createDataFrame([], schema)
    shares = []
    for deeper in range(len(levels) - 1, 0, -1):
        weighted = levels[deeper].join(share, state, "left").select(
            WINDOW, "origin", F.col("node").alias("Destination"),
            ((F.coalesce("share", F.lit(0.0)) + 1.0) / F.col("paths")).alias("weight"),
        )
        # from a level back to the one before it, along the same slices of the adjacency
        share = durable(
            _visit(levels[deeper - 1]).join(links, [WINDOW, "node", "salt"])
            .join(weighted, [WINDOW, "origin", "Destination"])
            .groupBy(*state)
            .agg((F.first("paths") * F.sum("weight")).alias("share"))
        )
        shares.append(share)
    out = graph.sparkSession.createDataFrame([], schema)
    for one in shares:
        out = out.unionByName(one)
    return (
        out.filter("origin <> node")
        .groupBy(WINDOW, F.col("node").alias("IP"))
        .agg(F.sum("share").alias("share"))
    )


def _eigenvector_by_joins(
    edges: DataFrame, per_salt: int, steps: int, tolerance: float
) -> DataFrame:
    """Power iteration on large windows. A window that has settled is set aside with its values."""
    graph = durable(_salted(edges, per_salt))
    links = graph.select(WINDOW, F.col("Source").alias("IP"), "salt", "Destination")
    out = graph.select(WINDOW, F.col("Source").alias("IP"), F.col("src_salts").alias("salts")).distinct()
    members = nodes(edges).join(out, [WINDOW, "IP"], "left")
    count = members.groupBy(WINDOW).agg(F.count("*").alias("n"))
    moving = durable(
        members.join(count, WINDOW).select(
            WINDOW, "IP", F.coalesce("salts", F.lit(0)).alias("salts"), "n", (1.0 / F.col("n")).alias("x")
        )
    )
    settled = []
    for _ in range(steps):
        received = (
            _visit(moving).join(links, [WINDOW, "IP", "salt"])
            .groupBy(WINDOW, F.col("Destination").alias("IP")).agg(F.sum("x").alias("got"))
        )
        # written down once: the norm and the values to scale are both read from it
        summed = durable(
            moving.join(received, [WINDOW, "IP"], "left").withColumn(
                "y", F.col("x") + F.coalesce("got", F.lit(0.0))
            )
        )
        norms = summed.groupBy(WINDOW).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        scaled = durable(summed.join(norms, WINDOW).withColumn("y", F.col("y") / F.col("norm")))
        still = scaled.groupBy(WINDOW, "n").agg(
            (F.sum(F.abs(F.col("y") - F.col("x"))) >= F.col("n") * tolerance).alias("moves")
        )
        stepped = scaled.join(still.select(WINDOW, "moves"), WINDOW).select(
            WINDOW, "IP", "salts", "n", F.col("y").alias("x"), "moves"
        )
        settled.append(durable(stepped.filter(~F.col("moves"))))
        moving = durable(stepped.filter("moves").drop("moves"))
        if moving.isEmpty():
            break
    done = moving.withColumn("x", F.lit(0.0)).select(WINDOW, "IP", "x")
    for part in settled:
        if not part.isEmpty():
            done = done.unionByName(part.select(WINDOW, "IP", "x"))
    return done.withColumnRenamed("x", "eigenvector_centrality")


# --- both together -----------------------------------------------------------------------


def centralities(
    edges: DataFrame,
    measures: tuple[str, ...] = ("centrality", "eigenvector_centrality"),
    task_edges: int = TASK_EDGES,
    task_pairs: int = TASK_PAIRS,
    per_salt: int = SALT_DEGREE,
    state_rows: int = STATE_ROWS,
    steps: int = MAX_STEPS,
    tolerance: float = TOLERANCE,
    written: bool = False,
) -> DataFrame:
    """Betweenness and eigenvector centrality of every (window, node), unweighted and directed.

    Writes the edges down, unless ``written`` says they are, and sees whether a window is too
    large for a task; the joins of the second way are only planned when there is one.
    """
    kept = edges.select(WINDOW, "Source", "Destination")
    kept = kept if written else durable(kept)
    sizes = kept.groupBy(WINDOW).agg(F.count("*").alias("m"))
    beyond = sizes.filter(F.col("m") > task_edges).select(WINDOW)
    # a window has at most 2m nodes, so m * 2m pairs bound the work of its betweenness
    parts = F.ceil(F.lit(2.0) * F.col("m") * F.col("m") / task_pairs).cast("int")
    one = F.lit(1)
    small = kept.join(
        sizes.filter(F.col("m") <= task_edges).select(
            WINDOW, (F.greatest(one, parts) if "centrality" in measures else one).alias("parts")
        ),
        WINDOW,
    )
    result = _centralities_in_tasks(small, measures, steps, tolerance)
    if beyond.isEmpty():
        return result
    large = durable(kept.join(beyond, WINDOW, "left_semi"))
    tables = []
    if "centrality" in measures:
        tables.append(_betweenness_by_joins(large, per_salt, state_rows))
    if "eigenvector_centrality" in measures:
        tables.append(_eigenvector_by_joins(large, per_salt, steps, tolerance))
    joined = tables[0] if len(tables) == 1 else tables[0].join(tables[1], [WINDOW, "IP"])
    return result.unionByName(joined)


def betweenness(edges: DataFrame, **options) -> DataFrame:
    """Share of shortest paths through each node, scaled by (n-1)(n-2); zero up to two nodes."""
    return centralities(edges, ("centrality",), **options)


def eigenvector(edges: DataFrame, **options) -> DataFrame:
    """Eigenvector centrality by power iteration; zeros for a window that does not settle."""
    return centralities(edges, ("eigenvector_centrality",), **options)


def graph_metrics(edges: DataFrame, **options) -> DataFrame:
    """Degrees and both centralities, one row per (window, node), zero where undefined.

    The edges are written down once and serve all of them.
    """
    kept = durable(edges.select(WINDOW, "Source", "Destination"))
    zero = [F.coalesce(name, F.lit(0.0)).alias(name) for name in ("centrality", "eigenvector_centrality")]
    return (
        degrees(kept)
        .join(centralities(kept, written=True, **options), [WINDOW, "IP"], "left")
        .select(WINDOW, "IP", "in_degree", "out_degree", *zero)
    )
