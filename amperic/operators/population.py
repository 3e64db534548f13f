"""How many sensors reported around each day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.functions.clock import DAY, epoch, slot
from amperic.operators.ordered import islands


def sensor_spans(readings: DataFrame, *, window_days: int = 10) -> DataFrame:
    """Per sensor, the runs of days whose centred window holds a reading of it.

    Day ``D`` looks at ``[D - window/2, D + window/2)``. A sensor active on day
    ``a`` therefore counts on ``window`` consecutive days, and active days at
    most ``window`` apart make one run. Nothing is copied per window.
    """
    half = window_days // 2
    days = readings.select("core_id", slot(epoch(F.col("time")), DAY).alias("day_no"))
    runs = islands(days, "day_no", window_days, keys=["core_id"], width=3650)
    return runs.groupBy("core_id", "island").agg(
        (F.min("day_no") - (half - 1)).alias("first_day"), (F.max("day_no") + half).alias("last_day")
    )


def population(readings: DataFrame, *, window_days: int = 10) -> DataFrame:
    """``day``, ``sensors_reporting``: distinct sensors in the window around a day."""
    spans = sensor_spans(readings, window_days=window_days)
    steps = spans.select(
        F.explode(
            F.array(
                F.struct(F.col("first_day").alias("day_no"), F.lit(1).alias("change")),
                F.struct((F.col("last_day") + 1).alias("day_no"), F.lit(-1).alias("change")),
            )
        ).alias("s")
    )
    steps = steps.groupBy("s.day_no").agg(F.sum("s.change").alias("change"))
    # one row per day from here on
    by_day = W.orderBy("day_no")
    levels = steps.select(
        "day_no",
        F.sum("change").over(by_day).alias("sensors_reporting"),
        F.lead("day_no").over(by_day).alias("next_day"),
    ).filter("sensors_reporting > 0")
    return levels.select(
        F.explode(F.sequence("day_no", F.col("next_day") - 1)).alias("day_no"), "sensors_reporting"
    ).select(F.timestamp_seconds(F.col("day_no") * DAY).alias("day"), "sensors_reporting")


def population_members(readings: DataFrame, *, window_days: int = 10) -> DataFrame:
    """The sensors behind each count, one row per day and sensor."""
    spans = sensor_spans(readings, window_days=window_days)
    return spans.select(
        F.explode(F.sequence("first_day", "last_day")).alias("day_no"), "core_id"
    ).select(F.timestamp_seconds(F.col("day_no") * DAY).alias("day"), "core_id")


def with_population(outages: DataFrame, people: DataFrame, *, t: str = "outage_time", how: str = "left") -> DataFrame:
    """Attach the population of the day an outage fell on."""
    keyed = outages.withColumn("day", F.date_trunc("day", F.timestamp_seconds(t)))
    return keyed.join(people, "day", how).drop("day")
