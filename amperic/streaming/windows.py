"""The sliding-window operators over a stream of readings.

The batch functions are plain windowed aggregations, so a watermark is all a
stream needs; late readings are dropped past it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from amperic.operators.snapshots import majority_resample, powered_snapshot


def stream_snapshot(readings: DataFrame, *, lateness: str = "10 minutes") -> DataFrame:
    """Sensors powered throughout ``[minute, minute + 4 min)``, emitted once closed."""
    return powered_snapshot(readings.withWatermark("time", lateness))


def stream_resample(readings: DataFrame, *, lateness: str = "10 minutes") -> DataFrame:
    """Majority power state around each minute, emitted once closed."""
    return majority_resample(readings.withWatermark("time", lateness))
