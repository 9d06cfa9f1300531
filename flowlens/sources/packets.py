"""Packet tables from CSV files, streams of CSV files, or any table with the right columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowlens.schema import PACKET_COLUMNS, packet_schema


def short_names(raw: DataFrame, *others: str) -> DataFrame:
    """Rename the capture columns to their short names."""
    return raw.select(*[F.col(f"`{name}`").alias(short) for name, short in PACKET_COLUMNS.items()], *others)


def good_packets(packets: DataFrame, observation: Observation | None = None) -> DataFrame:
    """The packets of lines that fit the schema, of a capture read with ``bad_lines``.

    ``observation`` counts lines in the scan that reads them, as ``n_lines`` and ``n_bad``; it
    has its numbers as soon as an action on the result has run.
    """
    if observation is not None:
        packets = packets.observe(observation, F.count("*").alias("n_lines"), F.count(BAD_LINE).alias("n_bad"))
    return packets.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE)


def parsed_time(epoch_seconds: Column) -> Column:
    """Timestamp of epoch seconds, cut to whole microseconds."""
    return F.timestamp_micros((epoch_seconds * 1_000_000).cast("long"))


#: The column of a line that does not fit the schema, whole and as it stands.
BAD_LINE = "bad_line"


def read_packets_csv(
    spark: SparkSession, path: str, row_id: bool = False, ordered: bool = False, bad_lines: bool = False
) -> DataFrame:
    """Packets of a ``;``-separated capture with a header.

    With ``bad_lines`` a column of that kind holds every line with too few or too many fields, or
    with a field of the wrong type; without it such a line gives what can be read of it. See
    :func:`good_packets`. ``row_id`` and ``ordered`` are off by default: an id column keeps filters from moving
    below it, and a global sort shuffles the capture though nothing after it needs the order.
    """
    schema, options = packet_schema(), {}
    if bad_lines:
        schema = schema.add(BAD_LINE, "string")
        # all fields are parsed, or whether a line is bad would depend on the columns a query takes
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE, "columnPruning": False}
    raw = spark.read.options(**options).csv(path, header=True, sep=";", schema=schema)
    packets = short_names(raw, BAD_LINE) if bad_lines else short_names(raw)
    if bad_lines:  # both branches are the line; the condition reads every column
        line = F.col(BAD_LINE)
        every = F.xxhash64(*PACKET_COLUMNS.values()) == 0
        packets = packets.withColumn(BAD_LINE, F.when(every, F.concat(line, F.lit(""))).otherwise(line))
    packets = packets.withColumn("parsed_time", parsed_time(F.col("time_epoch")))
    if row_id:
        packets = packets.withColumn("id", F.monotonically_increasing_id())
    return packets.orderBy("parsed_time") if ordered else packets


def read_packet_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same packets, read as a stream of files that arrive in a folder."""
    reader = spark.readStream.option("header", True).option("sep", ";").schema(packet_schema())
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return short_names(reader.csv(path)).withColumn("parsed_time", parsed_time(F.col("time_epoch")))


def preview(packets: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows of a capture."""
    return packets.limit(rows)


def packets_from_table(df: DataFrame, mapping: Mapping[str, Column]) -> DataFrame:
    """Any table as packets: ``mapping`` gives an expression for every packet column.

    ``Source``, ``Destination``, ``parsed_time`` and ``frame_len`` are required. The time
    column keeps its type, so a filter on it can reach the scan.
    """
    missing = {"Source", "Destination", "parsed_time", "frame_len"} - set(mapping)
    if missing:
        raise ValueError(f"no expression for {sorted(missing)}")
    return df.select(*[expression.alias(name) for name, expression in mapping.items()])


def _incomplete() -> Column:
    return F.col("Source").isNull() | F.col("Destination").isNull() | F.col("parsed_time").isNull()


def complete_packets(packets: DataFrame) -> DataFrame:
    """Packets with both endpoints and a time; the rest cannot be placed in a window."""
    return packets.filter(~_incomplete())


def count_incomplete(packets: DataFrame) -> DataFrame:
    """How many packets :func:`complete_packets` leaves out."""
    return packets.agg(F.count_if(_incomplete()).alias("n_incomplete"))
