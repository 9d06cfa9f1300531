"""Time predicates and conversions.

Instants are compared as integer microseconds wherever arithmetic is involved. A plain
range filter compares the column in its own type instead, so it reaches the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def to_micros(moment: datetime | int) -> int:
    """Microseconds since the epoch; a datetime without zone is read as UTC."""
    if isinstance(moment, int):
        return moment
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return (moment - EPOCH) // timedelta(microseconds=1)


def from_micros(micros: int) -> datetime:
    return EPOCH + timedelta(microseconds=micros)


def micros_sql(column: str) -> str:
    """Microseconds since the epoch of a timestamp column, as SQL text (session zone UTC)."""
    return f"unix_micros(CAST({column} AS timestamp))"


def micros_of(column: str) -> Column:
    return F.expr(micros_sql(column))


def instant(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def _literal(moment: datetime | int, kind: T.DataType) -> Column:
    value = from_micros(to_micros(moment))
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(value.replace(tzinfo=None)).cast("timestamp_ntz")
    return F.lit(value)


def is_between_time(
    column: Column, start: Column, end: Column, include_start: bool = True, include_end: bool = True
) -> Column:
    """Boolean mask of the values between two bounds, each inclusive or not."""
    lower = column >= start if include_start else column > start
    upper = column <= end if include_end else column < end
    return lower & upper


def between_time(
    df: DataFrame, on: str, start: datetime | int, end: datetime | int,
    include_start: bool = True, include_end: bool = True,
) -> DataFrame:
    """Rows whose time lies between two bounds."""
    kind = df.schema[on].dataType
    return df.filter(
        is_between_time(F.col(on), _literal(start, kind), _literal(end, kind), include_start, include_end)
    )


def in_time_range(
    df: DataFrame, start: datetime | int | None = None, end: datetime | int | None = None,
    include_lower: bool = True, include_upper: bool = True, on: str = "parsed_time",
) -> DataFrame:
    """Rows of a time range; a bound left out is open, and without bounds the input comes back."""
    kind = df.schema[on].dataType
    if start is not None:
        low = _literal(start, kind)
        df = df.filter(F.col(on) >= low if include_lower else F.col(on) > low)
    if end is not None:
        high = _literal(end, kind)
        df = df.filter(F.col(on) <= high if include_upper else F.col(on) < high)
    return df


def padded_slice(
    df: DataFrame, start: datetime | int, end: datetime | int, padding_seconds: int = 10
) -> DataFrame:
    """The request range widened by a padding on both sides, both bounds included."""
    pad = padding_seconds * 1_000_000
    return in_time_range(df, to_micros(start) - pad, to_micros(end) + pad)


def segment_split(
    df: DataFrame, train: tuple[datetime, datetime], test: tuple[datetime, datetime], on: str = "parsed_time"
) -> tuple[DataFrame, DataFrame]:
    """Training and testing rows, each a half-open time range."""
    return (
        in_time_range(df, *train, include_upper=False, on=on),
        in_time_range(df, *test, include_upper=False, on=on),
    )


def iso_string(column: Column) -> Column:
    """ISO text of a timestamp; the fraction appears only when it is not zero."""
    fraction = F.unix_micros(column.cast("timestamp")) % 1_000_000
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(fraction == 0, whole).otherwise(
        F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def iso_to_timestamp(column: Column) -> Column:
    """Timestamp of an ISO text."""
    return F.to_timestamp(column)
