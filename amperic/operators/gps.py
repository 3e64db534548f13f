"""How far GPS fixes lie from the recorded location of a deployment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.functions.geo import planar_metres
from amperic.operators.readings import deployed


def gps_accuracy(
    readings: DataFrame,
    deployments: DataFrame,
    *,
    start: str = "2018-07-01",
    end: str = "2019-09-01",
    min_satellites: float | None = 4,
    by_site: bool = True,
) -> DataFrame:
    """Fixes per deployment: period, counts, mean fix, recorded place, distance.

    The period is closed at both ends. ``min_satellites=None`` only asks for a
    known satellite count. NaN counts as more than any number of satellites, and
    fixes without a longitude are left out where satellites are counted.
    """
    rows = readings.filter(
        F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )
    if min_satellites is None:
        rows = rows.filter(F.col("gps_satellites").isNotNull() & ~F.isnan("gps_satellites"))
    else:
        rows = rows.filter(
            F.col("gps_longitude").isNotNull()
            & ~F.isnan("gps_longitude")
            & (F.col("gps_satellites") >= min_satellites)
        )
    fixes = deployed(rows, deployments, site_below=None, products=None, end_inclusive=False)
    keys = ["core_id", "valid_from"] + (["site_id"] if by_site else [])
    per = fixes.groupBy(*keys).agg(
        F.min("time").alias("mintime"),
        F.max("time").alias("maxtime"),
        F.count("*").alias("n_gps_samples"),
        F.avg("gps_satellites").alias("gps_satellites_avg"),
        F.avg("gps_latitude").alias("lat_avg"),
        F.max("location_latitude").alias("lat_fixed"),
        F.avg("gps_longitude").alias("lon_avg"),
        F.max("location_longitude").alias("lon_fixed"),
    )
    apart = planar_metres(F.col("lat_avg"), F.col("lon_avg"), F.col("lat_fixed"), F.col("lon_fixed"))
    return per.withColumn("dist_diff_meters", apart).orderBy(F.desc("dist_diff_meters"))
