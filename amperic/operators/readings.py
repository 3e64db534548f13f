"""Readings of deployed sensors: validity join and the usual filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Product ids in the study, open ends of a deployment.
PRODUCTS = (7008, 7009, 7010, 7011, 8462)
OPEN_START = "1970-01-01 00:00:00"
OPEN_END = "9999-01-01 00:00:00"


def validity(deployments: DataFrame) -> DataFrame:
    """Deployments with an integer site and closed-over open interval ends."""
    return deployments.select(
        "core_id",
        "location_latitude",
        "location_longitude",
        F.col("site_id").try_cast("int").alias("site_id"),
        F.coalesce("deployment_start_time", F.lit(OPEN_START).cast("timestamp")).alias("valid_from"),
        F.coalesce("deployment_end_time", F.lit(OPEN_END).cast("timestamp")).alias("valid_to"),
    )


def deployed(
    readings: DataFrame,
    deployments: DataFrame,
    *,
    start: str | None = None,
    end: str | None = None,
    site_below: int | None = 100,
    products: Sequence[int] | None = PRODUCTS,
    end_inclusive: bool = True,
) -> DataFrame:
    """Readings taken while their sensor was deployed.

    With ``end_inclusive`` a reading on a boundary shared by two deployments
    belongs to both. ``start``/``end`` is half-open. The join strategy is left
    to the planner: it broadcasts the deployments only below its size limit and
    otherwise splits hot sensors at run time.
    """
    rows = readings
    if start is not None:
        rows = rows.filter(F.col("time") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.filter(F.col("time") < F.lit(end).cast("timestamp"))
    if products is not None:
        rows = rows.filter(F.col("product_id").isin(list(products)))
    spans = validity(deployments)
    if site_below is not None:
        spans = spans.filter(F.col("site_id") < site_below)
    upto = F.col("time") <= F.col("valid_to") if end_inclusive else F.col("time") < F.col("valid_to")
    return rows.join(spans, "core_id").filter((F.col("time") >= F.col("valid_from")) & upto)
