"""Power transitions, outages with restore times, and per-sensor numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.functions.clock import DAY, corrected_time, epoch, slot
from amperic.operators.ordered import even_slices, neighbours, running
from amperic.session import stage

# Order of a sensor's readings.
ORDER = ("time", "event_id")
# Order of readings that carry no event id, as the database query returns them.
BARE_ORDER = ("time", "millis", "is_powered")


def _order(readings: DataFrame, order: Sequence[str] | None) -> Sequence[str]:
    if order is not None:
        return order
    return ORDER if "event_id" in readings.columns else BARE_ORDER


def narrowed(readings: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The columns that transitions and outages are made from, written once."""
    order = _order(readings, order)
    optional = ["event_id", "millis", "last_unplug_millis", "last_plug_millis", "location_latitude", "location_longitude"]
    wanted = dict.fromkeys(["core_id", "time", "is_powered", *order, *[c for c in optional if c in readings.columns]])
    return stage(readings.select(*wanted))


def power_edges(
    readings: DataFrame, *, order: Sequence[str] | None = None, slices: int | None = None, staged: bool = False
) -> DataFrame:
    """Readings that start something: a power state, a slice of the sensor's
    readings, or a day of the sensor; and those that end a slice. Staged.

    Readings are cut into even slices by sensor and order, so a sensor with most
    of the rows, in however short a time, is spread over many tasks. A state that
    lasts over a slice border is settled from one row per sensor and slice.

    Adds ``_slice`` and ``_changed``. The days in this table are the days on which
    a sensor reported, so counts of reporting sensors need no other scan.
    """
    order = _order(readings, order)
    rows = even_slices(readings if staged else narrowed(readings, order), ["core_id"], order, slices)
    w = W.partitionBy("core_id", "_slice").orderBy(*order)
    day = slot(epoch(F.col("time")), DAY)
    rows = rows.withColumns({
        "_before": F.lag(F.struct("is_powered")).over(w),
        "_closes": F.lead(F.lit(1)).over(w).isNull(),
        "_other_day": F.coalesce(F.lag(day).over(w) != day, F.lit(True)),
    })
    turned = F.coalesce(F.col("_before.is_powered") != F.col("is_powered"), F.lit(False))
    kept = stage(rows.filter(turned | F.col("_before").isNull() | F.col("_closes") | F.col("_other_day")))

    # one row per sensor and slice
    last = kept.filter("_closes").select("core_id", "_slice", F.struct("is_powered").alias("_state"))
    carried = last.select("core_id", "_slice", F.lag("_state").over(W.partitionBy("core_id").orderBy("_slice")).alias("_carried"))
    kept = kept.join(carried, ["core_id", "_slice"], "left")
    before = F.coalesce("_before", "_carried")["is_powered"]
    changed = F.coalesce(before != F.col("is_powered"), F.lit(False))
    return stage(kept.withColumn("_changed", changed).drop("_before", "_carried", "_closes", "_other_day"))


def transitions(readings: DataFrame, *, order: Sequence[str] | None = None, slices: int | None = None) -> DataFrame:
    """Readings whose power state differs from the sensor's previous reading.

    The first reading of a sensor and readings next to an unknown state are no
    transitions.
    """
    edges = power_edges(readings, order=order, slices=slices).filter("_changed")
    return edges.select(*[c for c in readings.columns if c in edges.columns])


def outages(
    readings: DataFrame, *, order: Sequence[str] | None = None, slices: int | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """One row per outage: an off-transition between two on-transitions.

    ``outage_time`` is when the plug edge went down by the device clock, and
    ``restore_time`` the corrected plug time of the sensor's next transition.
    Neighbours are looked up among transitions only, so the off-transition a
    sensor starts with is no outage. ``edges`` are the readings' power edges, if
    they are at hand.
    """
    order = _order(readings, order)
    rows = (power_edges(readings, order=order, slices=slices) if edges is None else edges).filter("_changed")
    rows = rows.withColumn(
        "outage_time", epoch(corrected_time(F.col("time"), F.col("millis"), F.col("last_unplug_millis")))
    ).withColumn("_plugged", epoch(corrected_time(F.col("time"), F.col("millis"), F.col("last_plug_millis"))))
    rows = neighbours(
        rows,
        order,
        keys=["core_id"],
        previous={"_was_on": "is_powered"},
        following={"_is_on": "is_powered", "restore_time": "_plugged"},
    )
    optional = [c for c in ("event_id", "location_latitude", "location_longitude") if c in rows.columns]
    head = ["core_id", *[c for c in optional if c == "event_id"], "time", "outage_time", "restore_time"]
    return rows.filter(~F.col("is_powered") & F.col("_was_on") & F.col("_is_on")).select(
        *head, *[c for c in optional if c != "event_id"]
    )


def number_per_sensor(outages: DataFrame, *, t: str = "outage_time", tie: str = "event_id", slices: int | None = None) -> DataFrame:
    """0-based position of each outage among its sensor's outages."""
    rows = stage(even_slices(outages, ["core_id"], [t, tie], slices).withColumn("_one", F.lit(1).cast("bigint")))
    rows = running(rows, [t, tie], "_one", "sum", "ordinal", keys=["core_id"], exclusive=True)
    return rows.drop("_slice", "_one")
