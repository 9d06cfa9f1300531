"""Connected components of a graph of any size, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.durable import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest node that each node reaches: columns ``node`` and ``component``.

    Alternates the large-star and the small-star step, each a grouping for the smallest
    neighbour and a join, until the edges form stars. Nodes are longs. Loops and repeated
    edges do no harm, null ends are dropped; a table without edges gives an empty table.
    Every step writes its edges to the shared folder, so lost executors cost one step.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    now = scratch.keep(ends.where("x is not null and y is not null and a != b").select("a", "b").distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.keep(large.where("a != b").distinct())
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(smallest, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = scratch.keep(rest.union(smallest.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now, large)
        before, now, state = state, following, _state(following)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
