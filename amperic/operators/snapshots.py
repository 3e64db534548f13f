"""Which sensors had power around a minute, and how outages relate to them.

Results stay in long form, one row per minute and sensor or place: a list per
minute would put a whole minute into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.functions.clock import epoch, floor_epoch, MINUTE


SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _seconds(span: str) -> int:
    n, unit = span.split()
    return int(n) * SECONDS[unit.rstrip("s")]


def _place():
    return F.struct("location_latitude", "location_longitude")


def _when():
    """Order of readings for the first place; the place itself settles ties."""
    return F.struct("time", "location_latitude", "location_longitude")


def _by_window(readings: DataFrame, window: str, slide: str, offset: str) -> DataFrame:
    """Per sensor and sliding window: ``begin`` (seconds), number of readings with
    a known state, of those with power, and the first place.

    A batch is folded into panes of one slide first, and only the panes are copied
    into the windows that hold them. A stream keeps one state per window.
    """
    known = [F.count("is_powered").alias("n"), F.sum(F.col("is_powered").cast("int")).alias("k")]
    if readings.isStreaming:
        spans = readings.groupBy("core_id", F.window("time", window, slide, offset).alias("w"))
        spans = spans.agg(*known, F.min_by(_place(), _when()).alias("place"))
        return spans.withColumn("begin", epoch(F.col("w.start")))
    step = _seconds(slide)
    panes = readings.groupBy("core_id", F.window("time", slide, slide, offset).alias("w")).agg(
        *known, F.min(_when()).alias("at")
    )
    starts = F.transform(F.sequence(F.lit(0), F.lit(_seconds(window) // step - 1)), lambda i: epoch(F.col("w.start")) - i * step)
    panes = panes.withColumn("begin", F.explode(starts))
    return panes.groupBy("core_id", "begin").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.min("at").alias("place")
    )


def powered_snapshot(readings: DataFrame, *, window: str = "4 minutes", slide: str = "1 minute") -> DataFrame:
    """Sensors powered in every reading of ``[minute, minute + window)``, at their
    first place there. Works on a stream as well."""
    spans = _by_window(readings, window, slide, "0 seconds").filter((F.col("n") > 0) & (F.col("k") == F.col("n")))
    return spans.select(F.timestamp_seconds("begin").alias("minute"), "core_id", "place.location_latitude", "place.location_longitude")


def majority_resample(
    readings: DataFrame, *, window: str = "5 minutes", slide: str = "1 minute", offset: str = "30 seconds"
) -> DataFrame:
    """Power state by majority around each whole minute; an even split is off."""
    spans = _by_window(readings, window, slide, offset)
    middle = F.col("begin") + F.lit(_seconds(window) // 2)
    return spans.select(
        "core_id",
        F.timestamp_seconds(middle).alias("time"),
        F.bround(F.try_divide("k", "n")).cast("int").alias("is_powered"),
        F.col("place.location_latitude").alias("powered_latitude"),
        F.col("place.location_longitude").alias("powered_longitude"),
    )


def outage_minute(t: str = "outage_time"):
    return F.timestamp_seconds(floor_epoch(F.col(t), MINUTE))


def with_powered(outages: DataFrame, snapshot: DataFrame, *, t: str = "outage_time", keep_unmatched: bool = False) -> DataFrame:
    """Attach ``n_powered``, the powered sensors at an outage's minute, and
    ``n_powered_others``, the same without the sensor itself.

    Outages without any powered sensor are dropped unless ``keep_unmatched``.
    The sensors themselves stay in ``snapshot`` under the same minute, so a
    minute that hits everybody costs one row per sensor, not one per pair.
    """
    counts = snapshot.groupBy("minute").agg(F.count("*").alias("n_powered"))
    own = snapshot.select("minute", "core_id").distinct().withColumn("_own", F.lit(1))
    rows = outages.withColumn("minute", outage_minute(t))
    rows = rows.join(counts, "minute", "left" if keep_unmatched else "inner")
    rows = rows.join(own, ["minute", "core_id"], "left")
    n = F.coalesce("n_powered", F.lit(0)).cast("bigint")
    return rows.withColumn("n_powered", n).withColumn(
        "n_powered_others", n - F.coalesce("_own", F.lit(0))
    ).drop("_own")


def minute_places(powered: DataFrame, out: DataFrame) -> DataFrame:
    """Distinct powered and outage places of the minutes that have both.

    ``powered`` and ``out`` hold ``(minute, lon, lat)``. A powered place that is
    also an outage place of the same minute is dropped, and minutes left without
    a powered place go with it. ``kind`` is ``powered`` or ``outage``.
    """
    spots = ["minute", "lon", "lat"]
    out = out.select(*spots).distinct()
    on = powered.select(*spots).distinct().join(out, spots, "left_anti")
    on = on.join(out.select("minute").distinct(), "minute", "left_semi")
    off = out.join(on.select("minute").distinct(), "minute", "left_semi")
    return on.withColumn("kind", F.lit("powered")).unionByName(off.withColumn("kind", F.lit("outage")))


def minute_shares(places: DataFrame) -> DataFrame:
    """Per minute: places of each kind, distinct longitudes, percent not powered."""
    on, off = F.col("kind") == "powered", F.col("kind") == "outage"
    per = places.groupBy("minute").agg(
        F.count(F.when(on, 1)).alias("powered_places"),
        F.count(F.when(off, 1)).alias("outage_places"),
        F.countDistinct(F.when(on, F.col("lon"))).alias("powered_lons"),
        F.countDistinct(F.when(off, F.col("lon"))).alias("outage_lons"),
    )
    share = F.try_divide(F.col("outage_lons"), F.col("outage_lons") + F.col("powered_lons")) * 100
    return per.withColumn("percent_not_powered", share)
