"""Cluster tables in long form and their per-cluster numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.functions.geo import albers_metres, great_circle_metres, planar_degrees, planar_metres
from amperic.operators.clusters_time import NOISE


def clustered(members: DataFrame, label: str = "label") -> DataFrame:
    return members.filter(F.col(label) != NOISE)


def cluster_summary(members: DataFrame, *, label: str = "label", t: str = "outage_time", other: str = "restore_time") -> DataFrame:
    """Size, ranges, spreads and means of every cluster, in one aggregation."""
    def spread(c):
        return F.max(c) - F.min(c)

    return clustered(members, label).groupBy(label).agg(
        F.count("*").alias("cluster_size"),
        F.countDistinct("core_id").alias("sensors"),
        F.min(t).alias("min_time"),
        F.max(t).alias("max_time"),
        spread(t).alias("time_range"),
        spread("location_latitude").alias("lat_range"),
        spread("location_longitude").alias("lon_range"),
        F.avg(t).alias("time_mean"),
        F.stddev_pop(t).alias("time_stddev"),
        F.avg(other).alias("other_mean"),
        F.stddev_pop(other).alias("other_stddev"),
        spread(other).alias("other_range"),
        F.floor(F.avg("sensors_reporting")).alias("sensors_reporting"),
    )


def latest_per_sensor(members: DataFrame, *, label: str = "label", t: str = "outage_time", id_col: str = "event_id") -> DataFrame:
    """One row per cluster and sensor: its last."""
    rest = [c for c in members.columns if c not in (label, "core_id")]
    kept = members.groupBy(label, "core_id").agg(
        F.max_by(F.struct(*rest), F.struct(t, id_col)).alias("_row")
    )
    return kept.select(label, "core_id", "_row.*")


def size_distribution(summary: DataFrame) -> DataFrame:
    """Clusters and mean time spread per cluster size."""
    return summary.groupBy("cluster_size").agg(
        F.count("*").alias("clusters"), F.avg("time_stddev").alias("mean_time_stddev")
    )


def since_first(members: DataFrame, *, label: str = "label", t: str = "outage_time") -> DataFrame:
    """Seconds from a cluster's first row to each of its rows."""
    first = members.groupBy(label).agg(F.min(t).alias("_first"))
    return members.join(first, label).withColumn("since_first", F.col(t) - F.col("_first")).drop("_first")


def of_size(members: DataFrame, sizes: Sequence[int], *, label: str = "label") -> DataFrame:
    """Members of clusters with one of the given row counts, with that count."""
    counts = clustered(members, label).groupBy(label).agg(F.count("*").alias("cluster_size"))
    return members.join(counts.filter(F.col("cluster_size").isin(list(sizes))), label)


def small_cluster_pairs(members: DataFrame, *, label: str = "label", order: Sequence[str] = ("outage_time", "event_id")) -> DataFrame:
    """Member pairs of the clusters of two and three, in the order first, second,
    third: 1-2, 2-3 and 3-1. Larger clusters have no pairs here, so a cluster
    yields at most three."""
    w = W.partitionBy(label).orderBy(*order)  # at most three rows
    at = F.struct("core_id", "location_latitude", "location_longitude", F.col(order[0]).alias("t"))
    rows = of_size(members, (2, 3), label=label)
    rows = rows.withColumn("pair", F.row_number().over(w)).withColumn("_one", at)
    rows = rows.withColumn(
        "_two", F.coalesce(F.lead("_one").over(w), F.when(F.col("cluster_size") == 3, F.first("_one").over(w)))
    ).filter(F.col("_two").isNotNull())
    return rows.select(
        label,
        "cluster_size",
        "pair",
        F.col("_one.t").alias("t"),
        *[F.col(f"_one.{c}").alias(f"{n}_1") for c, n in _ENDS],
        *[F.col(f"_two.{c}").alias(f"{n}_2") for c, n in _ENDS],
    )


_ENDS = (("core_id", "core"), ("location_latitude", "lat"), ("location_longitude", "lon"))


def with_distances(pairs: DataFrame) -> DataFrame:
    ends = [F.col(c) for c in ("lat_1", "lon_1", "lat_2", "lon_2")]
    return (
        pairs.withColumn("degrees", planar_degrees(*ends))
        .withColumn("planar_m", planar_metres(*ends))
        .withColumn("sphere_m", great_circle_metres(*ends))
        .withColumn("projected_m", albers_metres(*ends))
    )


def distance_shares(pairs: DataFrame, *, label: str = "label", limit_m: float = 550) -> DataFrame:
    """Per cluster size: share of pairs nearer than ``limit_m``, share of pairs
    one grid step apart, and share of clusters whose mean distance is nearer."""
    per_cluster = pairs.groupBy("cluster_size", label).agg(
        F.count("*").alias("_pairs"),
        F.sum((F.col("projected_m") < limit_m).cast("int")).alias("_near"),
        F.sum((F.col("grid_distance") == 1).cast("int")).alias("_step"),
        F.avg("projected_m").alias("_mean"),
    )
    return per_cluster.groupBy("cluster_size").agg(
        F.count("*").alias("clusters"),
        F.sum("_pairs").alias("pairs"),
        F.try_divide(F.sum("_near"), F.sum("_pairs")).alias("share_near"),
        F.try_divide(F.sum("_step"), F.sum("_pairs")).alias("share_same_transformer"),
        F.avg((F.col("_mean") < limit_m).cast("int")).alias("share_mean_near"),
    )
