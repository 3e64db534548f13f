"""Outages and clusters in time from a stream of readings.

Readings may come late, out of order and more than once. They wait, per sensor, until
the watermark has passed them, so they are taken in the order of their times, as in
the batch. What a sensor keeps besides is its last state, its last transition, and one
outage that is not restored yet.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from amperic.functions.clock import corrected_time, epoch

# Executors need not have this package installed: the processor travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_READING = "time_us bigint, event_id bigint, powered int, off_s bigint, on_s bigint"
_FIELDS = ("time_us", "event_id", "powered", "off_s", "on_s")
# The last reading's state (-1: unknown or none), the last transition's, and the open outage.
_STATE = "powered int, moved int, open boolean, event_id bigint, time_us bigint, off_s bigint"
_NEW = (-1, -1, False, 0, 0, 0)
_OUT = ("core_id", "event_id", "time_us", "outage_time", "restore_time")


def follow(state: tuple, reading: tuple) -> tuple[tuple, tuple | None]:
    """The state after one more reading, and the outage that it ends, if any."""
    powered, moved, open_, event_id, time_us, off_s = state
    now_us, now_id, now, now_off, now_on = reading
    ended = None
    if powered >= 0 and now >= 0 and powered != now:
        if open_ and now == 1:
            ended = (event_id, time_us, off_s, now_on)
        open_ = now == 0 and moved == 1
        if open_:
            event_id, time_us, off_s = now_id, now_us, now_off
        moved = now
    return (now, moved, open_, event_id, time_us, off_s), ended


class OutageProcessor(StatefulProcessor):
    """One sensor: readings that wait, and what it was doing."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _READING)
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(int(x) for x in r) for pdf in rows for r in pdf[list(_FIELDS)].itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            # the sensor is woken when the watermark has passed its earliest reading
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(set(self.waiting.get())) if self.waiting.exists() else []
        ready = [r for r in held if r[0] <= passed]
        if not ready:
            return
        later = held[len(ready) :]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        state = self.state.get() if self.state.exists() else _NEW
        found = []
        last = None
        for reading in ready:
            if last is not None and reading[:2] == last[:2]:
                continue  # the same reading once more
            state, ended = follow(tuple(state), reading)
            last = reading
            if ended:
                found.append((key[0], *ended))
        self.state.update(tuple(state))
        if found:
            yield pd.DataFrame(found, columns=list(_OUT))

    def close(self) -> None:
        pass


def stream_outages(readings: DataFrame, *, lateness: str = "10 minutes") -> DataFrame:
    """``core_id``, ``event_id``, ``time``, ``outage_time``, ``restore_time`` of each outage,
    emitted once the watermark has passed its restoring transition.

    Equal to ``outages`` in batch over the readings that the watermark has passed.
    Readings later than ``lateness`` are dropped; a reading with the same sensor, time
    and event id counts once. A reading without a time is ignored.

    Memory per sensor is the readings of one ``lateness``. The state store must be able to
    hold lists and timers, so the session is set to the RocksDB one.
    """
    spark = readings.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    at = lambda edge: epoch(corrected_time(F.col("time"), F.col("millis"), F.col(edge)))
    rows = readings.filter(F.col("time").isNotNull()).withWatermark("time", lateness).select(
        "core_id",
        "time",
        F.unix_micros(F.col("time").cast("timestamp")).alias("time_us"),
        F.col("event_id").cast("bigint").alias("event_id"),
        F.coalesce(F.col("is_powered").cast("int"), F.lit(-1)).alias("powered"),
        at("last_unplug_millis").alias("off_s"),
        at("last_plug_millis").alias("on_s"),
    )
    kind = readings.schema["core_id"].dataType.simpleString()
    found = rows.groupBy("core_id").transformWithStateInPandas(
        statefulProcessor=OutageProcessor(),
        outputStructType=f"core_id {kind}, event_id bigint, time_us bigint, outage_time bigint, restore_time bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return found.select("core_id", "event_id", F.timestamp_micros("time_us").alias("time"), "outage_time", "restore_time")


def stream_clusters(events: DataFrame, t: str = "time", *, eps: int = 90, lateness: str = "10 minutes") -> DataFrame:
    """Clusters of whole seconds at most ``eps`` apart, as ``dbscan_time`` finds them with
    ``min_samples`` 2: ``label`` (the first second, or -1 for a single row), ``first``,
    ``last`` and ``rows``, emitted once the watermark has passed the cluster's gap.

    Seconds are counted first, so that the sessions, which hold everything in one
    order, see a row a second and not all rows.
    """
    seconds = events.filter(F.col(t).isNotNull()).withWatermark(t, lateness).groupBy(F.window(t, "1 second")).agg(F.count("*").alias("n"))
    # the last instant of a second stands for it
    seconds = seconds.select(F.window_time("window").alias("at"), "n", F.lit(0).alias("_one"))
    # sessions of a stream need a key beside the time
    runs = seconds.groupBy(F.session_window("at", f"{eps} seconds"), "_one").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.sum("n").alias("rows")
    )
    whole = lambda c: F.unix_seconds(F.col(c))
    label = F.when(F.col("rows") >= 2, whole("first")).otherwise(F.lit(-1).cast("bigint"))
    return runs.select(label.alias("label"), whole("first").alias("first"), whole("last").alias("last"), "rows")
