"""Packet views of the test tables, and the window geometries the registered queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.timerange import micros_sql
from flowlens.operators.windows import SECOND
from flowlens.plans.features import Capture
from flowlens.sources.packets import packets_from_table

HOUR = 3600
DAY = 24 * HOUR
BOTS = ["10.0.0.3", "10.0.0.17"]

# (size, offset) in seconds
STATS = (6 * HOUR, HOUR)
GRAPH = (12 * HOUR, 12 * HOUR)
FEATURES = (12 * HOUR, 6 * HOUR)
SHIPMENTS = (30 * DAY, 5 * DAY)

EMBEDDING_COLUMNS = [f"f{i}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_packets(events: DataFrame) -> DataFrame:
    """Events as packets among 24 addresses, without equal times."""
    return packets_from_table(
        events,
        {
            "Source": F.expr("concat('10.0.0.', user_id % 24)"),
            "Destination": F.expr("concat('10.0.0.', (event_id * 7 + user_id) % 24)"),
            "Protocol": F.col("event_type"),
            "parsed_time": F.col("ts"),
            "time_epoch": F.expr("unix_micros(CAST(ts AS timestamp)) / 1e6D"),
            "frame_len": F.expr("CAST(floor(value * 100) AS int)"),
        },
    )


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_packets(table(spark, sf_dir, "events"))


def shipment_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as packets from the customer's to the supplier's nation, with many equal times."""
    joined = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
        .join(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey"), "l_orderkey")
        .join(table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey"), "o_custkey")
        .join(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey"), "l_suppkey")
    )
    return packets_from_table(
        joined,
        {
            "Source": F.expr("concat('N', c_nationkey)"),
            "Destination": F.expr("concat('N', s_nationkey)"),
            "parsed_time": F.col("l_shipdate"),
            "frame_len": F.col("l_quantity").cast("int"),
        },
    )


def event_capture(spark: SparkSession, sf_dir: str, geometry: tuple[int, int]) -> Capture:
    return Capture.open(event_packets(spark, sf_dir), *geometry)


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as features; labels below 5 are one concept, the others come in three batches."""
    parts = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(EMBEDDING_COLUMNS)]
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", (F.col("vec_id") % 3).alias("batch_id"), *parts
    )


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type and hour the share of values above a level that moves every five days."""
    start = event_capture(spark, sf_dir, STATS).start
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "event_type AS series", f"({micros_sql('ts')} - {start}) div {HOUR * SECOND} AS seq", "value"
        )
        .selectExpr("series", "seq", "CAST(value > 10 + 20 * (seq div 120 % 3) AS long) AS above")
        .groupBy("series", "seq").agg(F.expr("sum(above) / count(*) AS value"))
    )


def civil(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the test tables have them."""
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    return df.selectExpr(*[
        f"CAST({c} AS timestamp_ntz) AS {c}" if c in zoned else f"`{c}`" for c in df.columns
    ])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.selectExpr(*[f"round({c}, 6) AS {c}" if c in columns else f"`{c}`" for c in df.columns])
