"""Clustering of outages by time alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.functions.clock import DAY, iso_week
from amperic.operators.kernels import merge_rounds, plot_points, reach_back, steep_clusters, whole_groups
from amperic.operators.ordered import count_within, even_slices, islands, neighbours, running, with_slice
from amperic.session import stage

NOISE = -1


def dbscan_time(
    rows: DataFrame,
    t: str = "outage_time",
    *,
    eps: float = 90,
    min_samples: int = 2,
    keys: Sequence[str] = (),
    width: int = DAY,
    label: str = "label",
) -> DataFrame:
    """Density clusters on whole seconds; the neighbourhood is closed and counts
    the row itself.

    A label is the first second of the cluster's core rows, noise is -1. A row
    near two clusters joins the earlier one. All ordering happens on distinct
    seconds per time slice; rows only join the finished labels.
    """
    keys = list(keys)
    at = [*keys, t]
    counts = rows.filter(F.col(t).isNotNull()).groupBy(*at).agg(F.count("*").alias("_n"))
    if min_samples <= 2:
        runs = islands(counts, t, eps, keys=keys, width=width)
        placed = counts.join(runs, at)
        sizes = placed.groupBy(*keys, "island").agg(F.sum("_n").alias("_size"))
        placed = placed.join(sizes, [*keys, "island"])
        found = F.when(F.col("_size") >= min_samples, F.col("island")).otherwise(F.lit(NOISE))
        labels = placed.select(*at, found.alias(label))
    else:
        reach = int(np.floor(eps))
        near = count_within(counts, t, "_n", reach, "_near", keys=keys, width=width)
        core = near.filter(F.col("_near") >= min_samples)
        runs = islands(core, t, reach, keys=keys, width=width)
        line = near.select(*at).join(runs, at, "left")
        line = line.withColumn("_core", F.when(F.col("island").isNotNull(), F.struct(F.col(t).alias("at"), "island")))
        line = with_slice(line, F.col(t), width)
        line = running(line, [t], "_core", "max", "_back", keys=keys)
        line = running(line, [t], "_core", "min", "_ahead", keys=keys, backward=True)
        found = (
            F.when(F.col(t) - F.col("_back.at") <= reach, F.col("_back.island"))
            .when(F.col("_ahead.at") - F.col(t) <= reach, F.col("_ahead.island"))
            .otherwise(F.lit(NOISE))
        )
        labels = line.select(*at, found.alias(label))
    return _labelled(rows, labels, at, label)


def _labelled(rows: DataFrame, labels: DataFrame, at: Sequence[str], label: str) -> DataFrame:
    """Rows with the label of their time; a row without a time is noise."""
    return rows.join(labels, list(at), "left").withColumn(label, F.coalesce(label, F.lit(NOISE)))


def agglomerate_time(
    rows: DataFrame,
    t: str = "outage_time",
    *,
    max_gap: int = 180,
    partition: str | None = "week",
    width: int = DAY,
    slices: int | None = None,
    margin: int = 64,
) -> DataFrame:
    """Iterative merging of outages in time, within an ISO week, or over all
    times with ``partition=None``.

    Each round merges every pair of mutually nearest groups less than
    ``max_gap`` apart; a group's time is the floored mean of its members. Groups
    with no neighbour that near are final.

    Rounds never cross a gap of ``max_gap``: means stay inside their members'
    range. So the runs of such gaps are solved on their own. A run holds distinct
    seconds with a count, and is cut into slices of about equal size (``slices``, or as
    the shuffle has), each solved in one task. What a slice's neighbours may change
    reaches inwards only until two groups are ``max_gap`` apart, as they stay so. The
    seconds it has reached are solved again, from both sides of the border and with
    ``margin`` times their number around them, until nothing is unsure. So no task
    holds a long run, and the result is that of the run as a whole.

    Adds ``cluster`` (first member second) and ``cluster_time``; both are NULL for
    rows without a time.
    """
    part = iso_week(F.col(t)) if partition == "week" else F.lit(0)
    counts = rows.filter(F.col(t).isNotNull()).groupBy(F.col(t)).agg(F.count("*").alias("_n")).withColumn("_week", part)
    runs = islands(counts, t, max_gap, keys=["_week"], closed=False, width=width)
    runs = runs.withColumnRenamed("island", "_run")
    run = ["_week", "_run"]
    nodes = stage(counts.join(runs, ["_week", t]).select(*run, F.col(t).alias("t"), "_n"))
    # one time, or two less than max_gap apart, end as one group whatever their counts
    sizes = nodes.groupBy(*run).agg(
        F.count("*").alias("_times"),
        F.floor(F.sum(F.col("t") * F.col("_n")) / F.sum("_n")).cast("bigint").alias("cluster_time"),
    )
    sized = nodes.join(sizes, run)
    plain = sized.filter("_times <= 2").select(F.col("t").alias(t), F.col("_run").alias("cluster"), "cluster_time")

    wide = stage(even_slices(sized.filter("_times > 2").select(*run, "t", "_n", "_times"), run, ["t"], slices))
    spans = wide.groupBy(*run, "_slice").agg(F.count("*").alias("_held"))
    before = W.partitionBy(*run).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_from", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    cut = wide.join(spans, [*run, "_slice"]).withColumns(
        {"_open_left": F.col("_from") > 0, "_open_right": F.col("_from") + F.col("_held") < F.col("_times")}
    )
    solved = stage(_solved(cut, run, max_gap))
    merged = solved.filter("sure")
    left = solved.filter("not sure")
    all_nodes = None
    while not left.isEmpty():
        if all_nodes is None:  # with their place in the run, by blocks
            all_nodes = stage(solved.select(*run, "t", "_n", "at", "_times", F.floor(F.col("at") / width).alias("_block")))
        gaps = islands(left.select(*run, "at"), "at", 1, keys=run, width=width)
        asked = gaps.groupBy(*run, F.col("island").alias("_ask")).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
        extra = (F.col("_last") - F.col("_first") + 1) * F.lit(margin)
        asked = stage(asked.withColumns({"_low": F.col("_first") - extra, "_high": F.col("_last") + extra}))
        blocks = F.sequence(F.floor(F.greatest("_low", F.lit(0)) / width), F.floor(F.col("_high") / width))
        near = asked.withColumn("_block", F.explode(blocks)).join(all_nodes, [*run, "_block"])
        near = near.filter(F.col("at").between(F.col("_low"), F.col("_high")))
        near = near.withColumns(
            {"_open_left": F.col("_low") > 0, "_open_right": F.col("_high") < F.col("_times") - 1, "_slice": "_ask", "_from": F.greatest("_low", F.lit(0))}
        )
        told = _solved(near, run, max_gap).withColumnRenamed("_slice", "_ask")
        told = stage(told.join(asked.select(*run, "_ask", "_first", "_last"), [*run, "_ask"]).filter("at between _first and _last"))
        merged = merged.select("t", "cluster", "cluster_time").unionByName(told.filter("sure").select("t", "cluster", "cluster_time"))
        left, margin = told.filter("not sure"), margin * 8
    merged = merged.select(F.col("t").alias(t), "cluster", "cluster_time")
    return rows.join(merged.unionByName(plain), t, "left")


def _solved(cut: DataFrame, run: Sequence[str], max_gap: int) -> DataFrame:
    """The groups of each slice: ``t``, ``cluster``, ``cluster_time``, ``sure`` and the
    place ``at`` in the run, which starts at ``_from``."""
    group = [*run, "_slice"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, group):
            times, copies = pdf["t"].to_numpy(), pdf["_n"].to_numpy()
            first, centre, at = np.empty_like(times), np.empty_like(times), np.empty_like(times)
            sure = np.empty(len(times), bool)
            for a, b in zip(starts, np.append(starts[1:], len(pdf))):
                ends = bool(pdf["_open_left"].iat[a]), bool(pdf["_open_right"].iat[a])
                joined, centre[a:b], sure[a:b] = merge_rounds(times[a:b], copies[a:b], max_gap, *ends)
                _, head, back = np.unique(joined, return_index=True, return_inverse=True)
                first[a:b] = times[a:b][head][back]
                at[a:b] = pdf["_from"].iat[a] + np.arange(b - a)
            yield pdf[[*group, "t", "_n", "_times"]].assign(cluster=first, cluster_time=centre, sure=sure, at=at)

    rows = cut.select(*group, "t", "_n", "_times", "_open_left", "_open_right", "_from")
    rows = rows.repartition(*group).sortWithinPartitions(*group, "t")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*group, "t", "_n", "_times").schema)
    return rows.mapInPandas(solve, f"{kinds}, cluster bigint, cluster_time bigint, sure boolean, at bigint")


def neighbour_gaps(rows: DataFrame, t: str = "outage_time", *, width: int = DAY) -> DataFrame:
    """Times one and two rows ahead and behind within the ISO week.

    One line per distinct second with its number of rows: ``lead1``/``lead2``
    belong to its last row, ``lag1``/``lag2`` to its first. Between rows of the
    same second every gap is zero, so nothing is lost by not listing them.
    """
    counts = rows.groupBy(F.col(t)).agg(F.count("*").alias("rows")).withColumn("week", iso_week(F.col(t)))
    counts = with_slice(counts, F.col(t), width)
    one = neighbours(
        stage(counts),
        [t],
        keys=["week"],
        previous={"lag1": t, "_lag_rows": "rows"},
        following={"lead1": t, "_lead_rows": "rows"},
    )
    two = neighbours(stage(one), [t], keys=["week"], previous={"_lag2": "lag1"}, following={"_lead2": "lead1"})
    return two.select(
        "week",
        t,
        "rows",
        "lead1",
        F.when(F.col("_lead_rows") > 1, F.col("lead1")).otherwise(F.col("_lead2")).alias("lead2"),
        "lag1",
        F.when(F.col("_lag_rows") > 1, F.col("lag1")).otherwise(F.col("_lag2")).alias("lag2"),
    )


def _reached(rows: DataFrame, t: str, max_eps: float, min_samples: int, period: int) -> DataFrame:
    """The distinct seconds of each period in OPTICS order with ``rows``, ``core_distance``,
    ``reachability``, ``predecessor`` (the second that gave it) and ``_unit``, the
    period's standard deviation."""
    rows = rows.filter(F.col(t).isNotNull())
    start = rows.agg(F.min(t)).scalar()
    placed = rows.withColumn("period_no", F.floor((F.col(t) - start) / period).cast("bigint"))
    unit = placed.groupBy("period_no").agg(F.stddev_pop(t).alias("_unit")).withColumn("_eps", F.col("_unit") * max_eps)
    counts = stage(placed.groupBy("period_no", t).agg(F.count("*").alias("rows")))

    # at most period * min_samples rows per window
    copies = counts.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("rows", F.lit(min_samples)))))
    w = W.partitionBy("period_no").orderBy(t, "_copy")
    blocks = [
        F.greatest(F.col(t) - F.lag(t, j).over(w), F.lead(t, min_samples - 1 - j).over(w) - F.col(t))
        for j in range(min_samples)
    ]
    whole = [F.lag(t, j).over(w).isNotNull() & F.lead(t, min_samples - 1 - j).over(w).isNotNull() for j in range(min_samples)]
    core = F.least(*[F.when(ok, b) for ok, b in zip(whole, blocks)])
    core = copies.withColumn("_core", core).groupBy("period_no", t).agg(F.min("_core").alias("_core"))
    nodes = counts.join(core, ["period_no", t]).join(unit, "period_no")
    nodes = nodes.withColumn("core_distance", F.when(F.col("_core") <= F.col("_eps"), F.col("_core").cast("double"))).drop("_core")

    def look_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, ["period_no"]):
            found, source = np.empty(len(pdf)), np.empty(len(pdf), np.int64)
            times = pdf[t].to_numpy()
            for a, b in zip(starts, np.append(starts[1:], len(pdf))):
                core = pdf["core_distance"].iloc[a:b].to_numpy(dtype=float)
                found[a:b], at = reach_back(times[a:b], core, pdf["_eps"].iloc[a])
                source[a:b] = times[a:b][at]
            yield pdf.assign(reachability=found, predecessor=source)

    nodes = stage(nodes).repartition("period_no").sortWithinPartitions("period_no", t)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    nodes = nodes.mapInPandas(look_back, f"{types}, reachability double, predecessor bigint").withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("core_distance", "reachability")}
    )
    return nodes.withColumn("predecessor", F.when(F.col("reachability").isNotNull(), F.col("predecessor")))


def optics_time(
    rows: DataFrame,
    t: str = "outage_time",
    *,
    max_eps: float = 0.7,
    min_samples: int = 5,
    period: int = 2 * DAY,
    cut: float | None = None,
) -> DataFrame:
    """OPTICS of each ``period`` (from the first row on), in its own standard
    deviations.

    In one dimension, from the first time on, the next object is always the next
    time: it is no farther from any processed object than a later one. So the
    ordering is time order and what remains is the core distance (of the
    ``min_samples``-th nearest row, itself included) and the reachability. A
    period holds at most ``period`` distinct seconds, whatever its rows, and
    copies of a second beyond ``min_samples`` cannot change a core distance.

    One line per distinct second: ``period_no``, ``rows``, ``core_distance`` and
    ``reachability`` (NULL past ``max_eps``), and ``label``: the clusters a
    reachability cut leaves (``max_eps`` unless ``cut`` is given, in standard
    deviations), named by their first second, noise -1.
    """
    nodes = _reached(rows, t, max_eps, min_samples, period).withColumn("_cut", F.col("_unit") * (max_eps if cut is None else cut))
    by_time = W.partitionBy("period_no").orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    apart = F.coalesce(F.col("reachability") > F.col("_cut"), F.lit(True))
    dense = F.coalesce(F.col("core_distance") <= F.col("_cut"), F.lit(False))
    begun = F.max(F.when(apart & dense, F.col(t))).over(by_time)
    label = F.when(apart & ~dense, F.lit(NOISE)).otherwise(begun)
    return nodes.withColumn("label", label).select("period_no", t, "rows", "core_distance", "reachability", "label")


def optics_xi(
    rows: DataFrame,
    t: str = "outage_time",
    *,
    max_eps: float = 0.7,
    min_samples: int = 5,
    period: int = 2 * DAY,
    xi: float = 0.05,
    min_cluster_size: int | None = None,
) -> DataFrame:
    """OPTICS clusters of each ``period`` by steep areas of the reachability.

    A point is steep where the next reachability is lower or higher by the share
    ``xi`` or more. A cluster runs from a steep-down area to a steep-up area over a
    valley that nothing between them reaches across; it has ``min_cluster_size`` rows
    (``min_samples`` unless given), and its last row was reached from inside it. Of
    nested clusters the innermost stays.

    Lines of ``period_no``, the second, ``label`` (a cluster's first second, noise
    -1) and ``rows``. Rows of one second differ in their place in the order alone, so
    a second may have lines of two labels. Rows without a time are left out.

    A second gives at most ``min_samples + 3`` points however many rows it has: a longer
    run of equal values ends every steep area. A period's points are scanned in one
    task, which they bound as in :func:`optics_time`; areas that a later one may still
    close are few, as each lies lower by ``xi`` than the one before.
    """
    least = min_samples if min_cluster_size is None else min_cluster_size
    nodes = _reached(rows, t, max_eps, min_samples, period)
    nodes = stage(nodes.select("period_no", F.col(t).alias("t"), "rows", "core_distance", "reachability", "predecessor"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, ["period_no"]):
            for a, b in zip(starts, np.append(starts[1:], len(pdf))):
                part = pdf.iloc[a:b]
                values = (part[c].to_numpy(dtype=float) for c in ("core_distance", "reachability", "predecessor"))
                points = plot_points(part["t"].to_numpy(), part["rows"].to_numpy(), *values, most=min_samples + 3)
                label = np.full(len(points), NOISE, np.int64)
                for first, last in steep_clusters(points, xi=xi, flat=min_samples, least=least):
                    label[first : last + 1] = points["t"][first]
                yield pd.DataFrame(
                    {"period_no": part["period_no"].iloc[0], t: points["t"], "label": label, "rows": points["weight"]}
                )

    ordered = nodes.repartition("period_no").sortWithinPartitions("period_no", "t")
    lines = ordered.mapInPandas(scan, f"period_no bigint, {t} bigint, label bigint, rows bigint")
    return lines.groupBy("period_no", t, "label").agg(F.sum("rows").alias("rows"))
