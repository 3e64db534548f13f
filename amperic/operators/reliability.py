"""Reliability indices over clustered outages.

Members carry ``label``, ``event_id``, ``core_id``, both times, a place and
``sensors_reporting``. Time columns are parameters: swapped, every index is the
one of restore clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperic.operators.clusters_time import NOISE
from amperic.operators.ordered import nearest
from amperic.operators.places import nearest_places
from amperic.operators.summary import clustered
from amperic.session import stage


def saifi(members: DataFrame, readings: DataFrame, *, label: str = "label") -> DataFrame:
    """Members of clusters per sensor and cluster, with its three parts."""
    parts = clustered(members, label).agg(
        F.count("*").alias("members"), F.countDistinct(label).alias("clusters")
    )
    sensors = readings.agg(F.countDistinct("core_id")).scalar()
    return parts.withColumn("sensors", sensors).withColumn(
        "saifi", F.try_divide(F.col("members"), F.col("sensors") * F.col("clusters"))
    )


def _population() -> Column:
    return F.floor(F.avg("sensors_reporting")).alias("people")


def _index(clusters: DataFrame) -> DataFrame:
    """Clusters with ``lasts`` (mean duration), ``size`` and ``people``."""
    return clusters.agg(
        F.count("*").alias("clusters"),
        F.try_divide(F.sum(F.col("lasts") * F.col("size")), F.avg("people")).alias("saidi"),
    )


def saidi(members: DataFrame, *, label: str = "label", t: str = "outage_time", other: str = "restore_time") -> DataFrame:
    """Interruption seconds per sensor: mean duration times size over clusters."""
    per = clustered(members, label).groupBy(label).agg(
        (F.avg(other) - F.avg(t)).alias("lasts"), F.count("*").alias("size"), _population()
    )
    return _index(per)


def with_other_label(
    members: DataFrame,
    others: DataFrame,
    lookup: DataFrame,
    *,
    label: str = "label",
    t: str = "outage_time",
    other: str = "restore_time",
    out: str = "other_label",
) -> DataFrame:
    """Attach to every cluster member the cluster of its other end.

    ``lookup`` lists outages; the first one of a sensor at ``t`` gives its
    ``other`` time. Exactly one member of ``others`` at that time lends its
    label. Members without a look-up row or without exactly one match get -1.
    """
    first = lookup.groupBy("core_id", t).agg(F.min_by(other, F.struct("time", "event_id")).alias("_other"))
    ends = clustered(others, label).groupBy("core_id", F.col(other).alias("_other")).agg(
        F.count("*").alias("_n"), F.min(label).alias("_label")
    )
    rows = clustered(members, label).join(first, ["core_id", t], "left")
    rows = rows.join(ends, ["core_id", "_other"], "left")
    found = F.when(F.col("_n") == 1, F.col("_label")).otherwise(F.lit(NOISE))
    return rows.withColumn(out, F.coalesce(found, F.lit(NOISE))).drop("_other", "_n", "_label")


def label_quality(rows: DataFrame, *, label: str = "label", out: str = "other_label") -> DataFrame:
    """Per cluster: distinct other labels (noise counts as one), share of noise, size."""
    return rows.groupBy(label).agg(
        F.countDistinct(out).alias("other_groups"),
        F.avg((F.col(out) == NOISE).cast("int")).alias("noise_share"),
        F.count("*").alias("size"),
    )


def other_sizes(rows: DataFrame, *, out: str = "other_label", other: str = "restore_time") -> DataFrame:
    """Per other label: how many members it holds and their mean time."""
    return rows.groupBy(out).agg(F.count("*").alias("other_size"), F.avg(other).alias("other_mean"))


def outside_share(rows: DataFrame, others: DataFrame, *, label: str = "label", out: str = "other_label") -> DataFrame:
    """Per other cluster, percent of its members that no cluster here holds."""
    sizes = clustered(others, label).groupBy(F.col(label).alias(out)).agg(F.count("*").alias("size"))
    held = rows.filter(F.col(out) != NOISE).groupBy(out).agg(F.count("*").alias("held"))
    return sizes.join(held, out, "left").fillna(0, ["held"]).withColumn(
        "percent_outside", (1 - F.col("held") / F.col("size")) * 100
    )


def saidi_by_noise(rows: DataFrame, *, label: str = "label", t: str = "outage_time", other: str = "restore_time", out: str = "other_label") -> DataFrame:
    """The index over the members with and without another cluster.

    Mean durations come from all members of a cluster, sizes from the part.
    """
    per = rows.groupBy(label).agg(
        (F.avg(other) - F.avg(t)).alias("lasts"),
        _population(),
        F.count(F.when(F.col(out) == NOISE, 1)).alias("noise"),
        F.count(F.when(F.col(out) != NOISE, 1)).alias("clustered"),
    )
    parts = F.explode(F.create_map(F.lit("noise"), F.col("noise"), F.lit("clustered"), F.col("clustered")))
    per = per.select("lasts", "people", parts.alias("part", "size")).filter("size > 0")
    return per.groupBy("part").agg(
        F.count("*").alias("clusters"),
        F.try_divide(F.sum(F.col("lasts") * F.col("size")), F.avg("people")).alias("saidi"),
    )


def _mean_times(rows: DataFrame, other: str, out: str) -> DataFrame:
    return rows.filter(F.col(out) != NOISE).groupBy(out).agg(F.avg(other).alias("mean_other"))


def nearest_in_time(rows: DataFrame, *, other: str = "restore_time", out: str = "other_label") -> DataFrame:
    """Give each noise member the label whose mean time is nearest (ties: lowest)."""
    means = _mean_times(rows, other, out)
    close = nearest(rows.filter(F.col(out) == NOISE), means, other, "mean_other", out)
    close = close.select(other, F.col("nearest_label").alias("_near"))
    return rows.join(close, other, "left").withColumn(
        out, F.when(F.col(out) == NOISE, F.coalesce("_near", out)).otherwise(F.col(out))
    ).drop("_near")


def nearest_in_space(
    rows: DataFrame,
    *,
    other: str = "restore_time",
    out: str = "other_label",
    lat: str = "location_latitude",
    lon: str = "location_longitude",
    id_col: str = "event_id",
) -> DataFrame:
    """Give each noise member the label of the nearest labelled place; of several
    labels there, the one nearest in mean time (ties: lowest)."""
    spot = [F.col(lon).alias("x"), F.col(lat).alias("y")]
    noise, known = rows.filter(F.col(out) == NOISE), rows.filter(F.col(out) != NOISE)
    asks = stage(noise.groupBy(*spot).agg(F.min(id_col).alias("ask_id")))
    places = stage(known.groupBy(*spot).agg(F.min(id_col).alias("place_id")))
    near = nearest_places(asks, places).select("ask_id", "place_id")

    marks = known.withColumns({"x": F.col(lon), "y": F.col(lat)}).join(places, ["x", "y"])
    marks = marks.select("place_id", out).distinct().join(_mean_times(rows, other, out), out)
    wanted = noise.withColumns({"x": F.col(lon), "y": F.col(lat)}).join(asks, ["x", "y"]).join(near, "ask_id")
    wanted = stage(wanted.select(id_col, "place_id", other))
    close = nearest(wanted, marks, other, "mean_other", out, keys=["place_id"])
    best = wanted.join(close, ["place_id", other]).groupBy(id_col).agg(
        F.min(F.struct("nearest_gap", "nearest_label")).alias("_best")
    )
    best = best.select(id_col, F.col("_best.nearest_label").alias("_near"))
    return rows.join(best, id_col, "left").withColumn(
        out, F.when(F.col(out) == NOISE, F.coalesce("_near", out)).otherwise(F.col(out))
    ).drop("_near")


def saidi_reassigned(
    rows: DataFrame,
    moved: DataFrame,
    *,
    label: str = "label",
    t: str = "outage_time",
    other: str = "restore_time",
    out: str = "other_label",
    updated_means: bool = False,
) -> DataFrame:
    """The index when a member ends at the mean time of its other cluster.

    ``moved`` is ``rows`` with noise reassigned. Means come from before the move
    (as after a move in time) or, with ``updated_means``, from after it (as after
    a move in space).
    """
    means = _mean_times(moved if updated_means else rows, other, out)
    ended = moved.join(means, out, "left").groupBy(label).agg(
        (F.avg("mean_other") - F.avg(t)).alias("lasts"), F.count("*").alias("size"), _population()
    )
    return _index(ended)


def relative_sizes(summary: DataFrame) -> DataFrame:
    return summary.withColumn(
        "relative_cluster_size", F.try_divide(F.col("cluster_size"), F.col("sensors_reporting"))
    )


def size_histogram(summary: DataFrame, unit: str = "day", *, t: str = "min_time", at_least: int = 1) -> DataFrame:
    """Clusters per calendar unit (hour, day, month) and size."""
    start = F.date_trunc(unit, F.timestamp_seconds(F.floor(t)))
    return summary.filter(F.col("cluster_size") >= at_least).groupBy(
        start.alias("start"), "cluster_size"
    ).agg(F.count("*").alias("clusters"))
