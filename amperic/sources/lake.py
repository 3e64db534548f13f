"""Readings as a table partitioned by day, and joins that read only the days they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amperic.functions.clock import DAY, epoch, slot
from amperic.operators.intervals import in_intervals
from amperic.operators.readings import deployed

DAY_COLUMN = "day"


def _day(seconds: Column) -> Column:
    """The day number of an epoch second."""
    return slot(seconds, DAY).cast("int")


def write_days(readings: DataFrame, path: str, *, t: str = "time", spread: int = 8, max_records: int = 5_000_000) -> None:
    """Overwrite a table of readings with one folder per day.

    A day is written by up to ``spread`` tasks, told by the sensor, so a day that holds
    most of the rows is no single task's work; readings without a time are in the folder
    of day NULL. Files are sorted by sensor and time, which keeps their statistics narrow.
    """
    rows = readings.withColumn(DAY_COLUMN, _day(epoch(F.col(t))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("core_id"), F.lit(spread)))
    rows = rows.repartition(DAY_COLUMN, "_part").sortWithinPartitions(DAY_COLUMN, "core_id", t).drop("_part")
    rows.write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy(DAY_COLUMN).parquet(path)


def read_days(spark: SparkSession, path: str, *, start: str | None = None, end: str | None = None, t: str = "time") -> DataFrame:
    """Readings of ``[start, end)``; other days' folders are not opened. Keeps ``day``."""
    rows = spark.read.parquet(path)
    if start is not None:
        first = F.lit(start).cast("timestamp")
        rows = rows.filter((F.col(t) >= first) & (F.col(DAY_COLUMN) >= _day(epoch(first))))
    if end is not None:
        # a bound at midnight does not ask for the day that begins there
        last = F.lit(end).cast("timestamp")
        rows = rows.filter((F.col(t) < last) & (F.col(DAY_COLUMN) <= _day(epoch(last - F.expr("interval 1 microsecond")))))
    return rows


def in_interval_days(lake: DataFrame, intervals: DataFrame, *, t: str = "time", start: str = "min_time", end: str = "max_time", how: str = "inner", width: int = 600) -> DataFrame:
    """Pairs of reading and interval, as :func:`in_intervals` finds them (``start`` and
    ``end`` in epoch seconds), from the days that some interval touches.

    The days are worked out from the intervals while the query runs; if they are few, as
    the planner sees by their size, they prune the scan before it opens a file.
    """
    days = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    days = days.select(F.explode(F.sequence(_day(F.col(start)), _day(F.col(end)))).alias("_day")).distinct()
    rows = lake.join(days, F.col(DAY_COLUMN) == F.col("_day"), "left_semi").withColumn("_seconds", epoch(F.col(t)))
    return in_intervals(rows, intervals, t="_seconds", start=start, end=end, how=how, width=width).drop("_seconds", DAY_COLUMN)


def deployed_days(spark: SparkSession, path: str, deployments: DataFrame, *, start: str, end: str, **how) -> DataFrame:
    """:func:`deployed` readings of ``[start, end)`` from a table by day."""
    rows = read_days(spark, path, start=start, end=end).drop(DAY_COLUMN)
    return deployed(rows, deployments, start=start, end=end, **how)
