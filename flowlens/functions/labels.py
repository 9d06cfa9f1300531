"""Labels: known bots as a 0/1 column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_bots(features: DataFrame, bots: Sequence[str] | DataFrame) -> DataFrame:
    """Add ``isBot``: 1 when the address is a known bot.

    ``bots`` is a list of addresses or a table with an ``IP`` column. The table is made
    distinct, so the join keeps one row per feature row; Spark broadcasts it when its
    size allows and joins by shuffle otherwise.
    """
    if not isinstance(bots, DataFrame):
        return features.withColumn("isBot", F.col("IP").isin(list(bots)).cast("int"))
    known = bots.select("IP").where(F.col("IP").isNotNull()).distinct().withColumn("_known", F.lit(1))
    return (
        features.join(known, "IP", "left")
        .withColumn("isBot", F.coalesce("_known", F.lit(0)))
        .drop("_known")
        .select(*features.columns, "isBot")
    )


def malicious(bots: Sequence[str]) -> Column:
    """A packet is malicious when its sender or its receiver is a bot."""
    bots = list(bots)
    return F.col("Source").isin(bots) | F.col("Destination").isin(bots)
