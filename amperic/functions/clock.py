"""Time expressions. Epoch values are whole seconds in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60
HOUR = 3600
DAY = 86400


def epoch(ts: Column) -> Column:
    """Timestamp to epoch seconds, fractions dropped."""
    return F.unix_timestamp(ts)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def floor_epoch(seconds: Column, width: int) -> Column:
    """Start of the ``width``-second slot that holds ``seconds``."""
    return (F.floor(seconds / F.lit(width)) * F.lit(width)).cast("bigint")


def slot(seconds: Column, width: int) -> Column:
    """Number of the ``width``-second slot that holds ``seconds``."""
    return F.floor(seconds / F.lit(width)).cast("bigint")


def parse_time(text: Column) -> Column:
    """``2018-07-01 12:00:00`` with or without a fraction; NULL when malformed."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")),
    )


def iso_week(seconds: Column) -> Column:
    """ISO week number; the year is ignored."""
    return F.weekofyear(from_epoch(seconds))


def corrected_time(time: Column, millis: Column, edge_millis: Column) -> Column:
    """Move ``time`` back to the plug edge the device clock recorded.

    The report time stands when either counter is missing (NULL or NaN), when
    there was no edge (0), or when the edge lies after the report.
    """
    usable = (
        millis.isNotNull()
        & edge_millis.isNotNull()
        & ~F.isnan(millis)
        & ~F.isnan(edge_millis)
        & (edge_millis != 0)
        & (edge_millis <= millis)
    )
    behind = millis.try_cast("bigint") - edge_millis.try_cast("bigint")
    moved = F.timestamp_micros(F.unix_micros(time) - behind * 1000)
    return F.when(usable, moved).otherwise(time)
