"""Readings that fall into time intervals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.functions.clock import slot


def in_intervals(
    rows: DataFrame,
    intervals: DataFrame,
    *,
    t: str = "time_s",
    start: str = "min_time",
    end: str = "max_time",
    how: str = "inner",
    width: int = 600,
) -> DataFrame:
    """Pairs of row and interval with ``start <= t <= end``.

    Intervals are listed under every time slot they touch and meet the rows of
    the same slot by equality; the exact bounds decide. With ``how="left"``
    intervals without a row stay.
    """
    slots = F.sequence(slot(F.col(start), width), slot(F.col(end), width))
    spread = intervals.withColumn("_slot", F.explode(slots))
    placed = rows.withColumn("_slot", slot(F.col(t), width))
    met = spread.join(placed, "_slot").filter(F.col(t).between(F.col(start), F.col(end))).drop("_slot")
    if how == "left":
        # met rows stay where they are; only intervals without any are looked up
        seen = met.select(*intervals.columns).distinct()
        same = reduce(and_, [intervals[c].eqNullSafe(seen[c]) for c in intervals.columns])
        return met.unionByName(intervals.join(seen, same, "left_anti"), allowMissingColumns=True)
    return met
