"""Reading the sensor database in parallel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from amperic.operators.readings import OPEN_END, OPEN_START, PRODUCTS

FORMAT = "%Y-%m-%d %H:%M:%S"


def time_predicates(start: str, end: str, *, days_per_part: int = 7, column: str = "time") -> list[str]:
    """Contiguous half-open conditions that cover ``[start, end)``, one per part.

    Whole parts only: the span is divided by their number, and bounds are cut to
    seconds. A span shorter than one part gives one condition.
    """
    first, last = (datetime.fromisoformat(v).replace(tzinfo=timezone.utc).timestamp() for v in (start, end))
    parts = max(1, int((last - first) / (days_per_part * 86400)))
    bounds = [int(first + i * (last - first) / parts) for i in range(parts + 1)]
    text = [datetime.fromtimestamp(b, timezone.utc).strftime(FORMAT) for b in bounds]
    return [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(text, text[1:])]


def deployed_query(
    start: str,
    end: str,
    *,
    readings: str = "readings",
    deployments: str = "deployment",
    site_below: int | None = 100,
    products: Sequence[int] | None = PRODUCTS,
) -> str:
    """Derived table that lets the database join and filter deployed readings."""
    where = [f"r.time >= '{start}'", f"r.time < '{end}'", "r.time >= d.valid_from", "r.time <= d.valid_to"]
    if site_below is not None:
        where.append(f"d.site_id < {site_below}")
    if products is not None:
        where.append(f"r.product_id IN ({', '.join(str(p) for p in products)})")
    spans = (
        "SELECT core_id, location_latitude, location_longitude, CAST(site_id AS INTEGER) AS site_id, "
        f"COALESCE(deployment_start_time, '{OPEN_START}+0') AS valid_from, "
        f"COALESCE(deployment_end_time, '{OPEN_END}+0') AS valid_to FROM {deployments}"
    )
    return (
        "(SELECT r.core_id, r.time, r.is_powered, r.product_id, r.millis, r.last_unplug_millis, "
        "r.last_plug_millis, d.location_latitude, d.location_longitude, d.site_id "
        f"FROM {readings} r JOIN ({spans}) d ON r.core_id = d.core_id WHERE {' AND '.join(where)}) deployed"
    )


def read_readings(
    spark: SparkSession, url: str, table: str, predicates: Sequence[str], properties: Mapping[str, str]
) -> DataFrame:
    """One partition per predicate, so that no task scans the whole table."""
    return spark.read.jdbc(url=url, table=table, predicates=list(predicates), properties=dict(properties))
