"""The stages most queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperic.operators.clusters_time import dbscan_time
from amperic.operators.population import population, with_population
from amperic.operators.readings import deployed
from amperic.operators.reliability import with_other_label
from amperic.operators.snapshots import majority_resample, minute_places, outage_minute, powered_snapshot
from amperic.operators.transitions import narrowed, outages, power_edges
from amperic.session import stage
from amperic.sources import fixtures

# Cluster radius of the shared cluster table, seconds.
EPS = 600


def study_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployed readings of the studied sites and products."""
    return deployed(fixtures.readings(spark, sf_dir), fixtures.deployments(spark, sf_dir))


def located_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployed readings of every site and product."""
    return deployed(
        fixtures.readings(spark, sf_dir), fixtures.deployments(spark, sf_dir), site_below=None, products=None
    )


def outage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outages with the population of their day, staged."""
    edges = power_edges(located_readings(spark, sf_dir))
    return stage(with_population(outages(edges, edges=edges), population(edges)))


def labelled(spark: SparkSession, sf_dir: str, t: str = "outage_time", eps: float = EPS) -> DataFrame:
    return stage(dbscan_time(outage_table(spark, sf_dir), t, eps=eps))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return powered_snapshot(located_readings(spark, sf_dir))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powered and outage places per minute."""
    rows = narrowed(located_readings(spark, sf_dir))
    on = majority_resample(rows).filter("is_powered = 1").select(
        F.col("time").alias("minute"), F.col("powered_longitude").alias("lon"), F.col("powered_latitude").alias("lat")
    )
    off = outages(rows, edges=power_edges(rows, staged=True)).select(
        outage_minute().alias("minute"),
        F.col("location_longitude").alias("lon"),
        F.col("location_latitude").alias("lat"),
    )
    # both are read twice
    return stage(minute_places(stage(on.distinct()), stage(off)))


def paired(spark: SparkSession, sf_dir: str, swap: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members of outage clusters with their restore cluster, and the members
    of restore clusters; the other way round with ``swap``."""
    rows = outage_table(spark, sf_dir)
    ends = ("restore_time", "outage_time") if swap else ("outage_time", "restore_time")
    here = stage(dbscan_time(rows, ends[0], eps=EPS))
    there = stage(dbscan_time(rows, ends[1], eps=EPS))
    return stage(with_other_label(here, there, rows, t=ends[0], other=ends[1])), there
