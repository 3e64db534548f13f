"""Distributions and cluster-quality measures: the tables behind the figures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.functions.clock import DAY
from amperic.operators.clusters_time import NOISE
from amperic.operators.kernels import kernel_sums
from amperic.operators.ordered import even_slices, neighbours, running, with_slice
from amperic.session import stage


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the range of ``col``; the last bin is closed.

    Empty bins are not listed. A constant column fills bin 1.
    """
    ends = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))).scalar()
    step = (ends["hi"] - ends["lo"]) / bins
    place = F.when(step == 0, F.lit(1)).otherwise(
        F.least(F.floor((F.col(col) - ends["lo"]) / step) + 1, F.lit(bins))
    )
    return df.filter(F.col(col).isNotNull()).groupBy(place.cast("bigint").alias("bucket")).agg(
        F.count("*").alias("n"), F.min(col).cast("double").alias("least"), F.max(col).cast("double").alias("most")
    )


def k_distance(rows: DataFrame, t: str = "outage_time", *, width: int = DAY) -> DataFrame:
    """Distance to the nearest other time, longest first.

    The ranked curve in runs: ``distance`` holds for the ranks ``rank_from`` to
    ``rank_to`` (1-based). Nothing is lost, and rows of one distance need not be
    numbered one by one.
    """
    counts = with_slice(rows.groupBy(t).agg(F.count("*").alias("n")), F.col(t), width)
    near = neighbours(counts, [t], previous={"_before": t}, following={"_after": t})
    gap = F.least(F.col(t) - F.col("_before"), F.col("_after") - F.col(t))
    curve = near.select(F.when(F.col("n") > 1, F.lit(0)).otherwise(gap).alias("distance"), "n")
    curve = stage(curve.filter("distance is not null").groupBy("distance").agg(F.sum("n").alias("n")))
    curve = running(with_slice(curve, F.col("distance"), width), ["distance"], "n", "sum", "rank_to", backward=True)
    return curve.select("distance", F.col("n").alias("rows"), (F.col("rank_to") - F.col("n") + 1).alias("rank_from"), "rank_to")


def knee(curve: DataFrame) -> DataFrame:
    """Rank and distance where a falling convex curve bends most.

    Both axes are scaled to [0, 1]; the knee lies farthest below the chord. A
    run's first rank is its farthest.
    """
    ends = curve.agg(
        F.struct(
            F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("rank_to").alias("last")
        )
    ).scalar()
    x = F.try_divide(F.col("rank_from") - 1, ends["last"] - 1)
    y = F.try_divide(F.col("distance") - ends["low"], ends["high"] - ends["low"])
    drop = 1 - y - x
    return curve.withColumn("_drop", drop).agg(
        F.max(F.struct("_drop", (-F.col("rank_from")).alias("_r"), "distance")).alias("k")
    ).select((-F.col("k._r")).alias("knee_rank"), F.col("k.distance").alias("knee_distance"), F.col("k._drop").alias("drop"))


def kneedle(curve: DataFrame, *, sensitivity: float = 1.0, slices: int | None = None) -> DataFrame:
    """First knee of a falling convex curve that stands out by ``sensitivity``.

    Both axes are scaled to [0, 1], and the difference between the chord and the curve
    is followed from its first local maximum on. A maximum is a knee once the
    difference falls below it by more than ``sensitivity`` mean steps of the rank, or
    below zero after a local minimum. No row if that never happens.

    ``curve`` is in runs of equal distance (:func:`k_distance`). Inside a run the
    difference falls by one step a rank, so only a run's first rank can be a maximum
    and only its last a minimum. The last maximum and the last threshold before each run
    are carried across even slices of the curve.
    """
    ends = curve.agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("rank_to").alias("last")).first()
    if ends["last"] is None or ends["last"] < 2 or ends["low"] == ends["high"]:
        return curve.select(
            F.col("rank_from").cast("bigint").alias("knee_rank"), F.col("distance").cast("double").alias("knee_distance"),
            F.lit(None).cast("double").alias("drop"),
        ).limit(0)
    steps = ends["last"] - 1
    drop = lambda rank: 1 - (F.col("distance") - ends["low"]) / (ends["high"] - ends["low"]) - (F.col(rank) - 1) / F.lit(float(steps))
    rows = curve.select(
        "distance", F.col("rank_from").cast("bigint").alias("a"), F.col("rank_to").cast("bigint").alias("b"),
        drop("rank_from").alias("_a"), drop("rank_to").alias("_b"),
    )
    rows = stage(even_slices(stage(rows), [], ["a"], slices))
    rows = neighbours(rows, ["a"], previous={"_before": "_b"}, following={"_after": "_a"})
    long_ = F.col("b") > F.col("a")
    top = F.coalesce(F.col("_a") >= F.col("_before"), F.lit(True)) & (long_ | F.coalesce(F.col("_a") >= F.col("_after"), F.lit(True)))
    low = F.coalesce(F.col("_b") <= F.col("_after"), F.lit(True)) & (long_ | F.coalesce(F.col("_b") <= F.col("_before"), F.lit(True)))
    # what holds from a rank on; at one rank a minimum comes after a maximum
    mark = lambda rank, turn, threshold: F.struct(F.col(rank).alias("rank"), F.lit(turn).alias("turn"), threshold.alias("threshold"))
    peak = F.when(top, mark("a", 0, F.col("_a") - sensitivity / steps))
    pit = F.when(low, mark("b", 1, F.lit(0.0)))
    rows = stage(rows.withColumns({"_peak": peak, "_last": F.coalesce(pit, peak), "_knee": F.when(top, F.struct("a", "distance", "_a"))}))
    rows = running(rows, ["a"], "_last", "max", "_held", exclusive=True)
    rows = running(rows, ["a"], "_knee", "max", "_of", exclusive=True)
    at_first = F.coalesce("_peak", "_held")["threshold"]
    at_last = F.coalesce("_last", "_held")["threshold"]
    falls = (long_ & (F.col("_b") < at_first)) | F.coalesce(F.col("_after") < at_last, F.lit(False))
    knees = rows.withColumn("_at", F.coalesce("_knee", "_of")).filter(falls & F.col("_at").isNotNull())
    first = knees.agg(F.min_by("_at", "a").alias("k")).filter("k is not null")
    return first.select(F.col("k.a").alias("knee_rank"), F.col("k.distance").cast("double").alias("knee_distance"), F.col("k._a").alias("drop"))


def fit_curve(points: DataFrame, x: str, y: str, weight: str, *, steps: int = 20, alpha: float = 0.1) -> DataFrame:
    """Gradient descent for ``y = a x + sin(b x)`` from (0, 0): one aggregation
    per step, only the two parameters pass through the driver.

    Returns the parameters before each step and the mean squared distance of
    ``y`` from ``a``, then the final pair with a NULL loss.
    """
    points = stage(points.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(weight).alias("w")))
    a = b = 0.0
    history = []
    for step in range(steps):
        miss = F.col("y") - F.col("x") * a - F.sin(F.col("x") * b)
        slope = F.col("x") * F.cos(F.col("x") * b)
        total = F.sum("w")
        sums = points.agg(
            (F.sum(F.col("w") * miss * F.col("x")) / total).alias("da"),
            (F.sum(F.col("w") * miss * slope) / total).alias("db"),
            (F.sum(F.col("w") * (F.col("y") - a) * (F.col("y") - a)) / total).alias("loss"),
        ).first()
        history.append((step, a, b, sums["loss"]))
        a, b = a + 2 * alpha * sums["da"], b + 2 * alpha * sums["db"]
    history.append((steps, a, b, None))
    return points.sparkSession.createDataFrame(history, "step bigint, a double, b double, loss double")


def _kde(spots: DataFrame, grid: int, cut: float, dims: int) -> DataFrame:
    """Gaussian kernel density on a grid, for ``x``, ``y``, ``weight``.

    Each task folds its points into one grid-sized matrix and only the matrices
    are shuffled. Bandwidths follow Scott's rule, n^(-1/(dims+4)) sample
    deviations per axis, with n and the deviations counting a point ``weight``
    times. The grid reaches ``cut`` bandwidths past the data. Without any spread
    along an axis, as for one point, there is no bandwidth and the result is empty.
    """
    w = F.col("weight")

    def moments(c):
        mean = F.sum(w * F.col(c)) / F.sum(w)
        return mean.alias(f"m{c}")

    first = spots.agg(F.sum("weight").alias("n"), moments("x"), moments("y")).first()
    n = float(first["n"] or 0)
    empty = spots.sparkSession.createDataFrame([], "ix bigint, iy bigint, gx double, gy double, density double")
    if n <= 1:
        return empty
    spread = spots.agg(
        *[F.sum(w * (F.col(c) - first[f"m{c}"]) * (F.col(c) - first[f"m{c}"])).alias(f"v{c}") for c in "xy"],
        *[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    scott = n ** (-1.0 / (dims + 4))
    h = {c: scott * math.sqrt(spread[f"v{c}"] / (n - 1)) for c in "xy"}
    if not h["x"] or dims == 2 and not h["y"]:
        return empty
    gx = np.linspace(spread["lox"] - cut * h["x"], spread["hix"] + cut * h["x"], grid)
    if dims == 1:
        gy, h["y"] = np.zeros(1), 1.0
    else:
        gy = np.linspace(spread["loy"] - cut * h["y"], spread["hiy"] + cut * h["y"], grid)
    hx, hy = h["x"], h["y"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(gx), len(gy)))
        for pdf in batches:
            total += kernel_sums(
                pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["weight"].to_numpy(dtype=float), gx, gy, hx, hy
            )
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"ix": i.ravel(), "iy": j.ravel(), "s": total.ravel()})

    norm = n * hx * hy * (2 * math.pi if dims == 2 else math.sqrt(2 * math.pi))
    sums = spots.select("x", "y", "weight").mapInPandas(fold, "ix bigint, iy bigint, s double")
    at = lambda g, i: F.element_at(F.array(*[F.lit(float(v)) for v in g]), (F.col(i) + 1).cast("int"))
    return sums.groupBy("ix", "iy").agg((F.sum("s") / norm).alias("density")).select(
        "ix", "iy", at(gx, "ix").alias("gx"), at(gy, "iy").alias("gy"), "density"
    )


def kde_grid(places: DataFrame, *, x: str = "lon", y: str = "lat", weight: str | None = None, grid: int = 16, cut: float = 3) -> DataFrame:
    """Density of places on a square grid; unweighted, or counting ``weight``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    spots = places.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("weight"))
    return _kde(stage(spots), grid, cut, 2)


def kde_line(values: DataFrame, col: str, *, grid: int = 32, cut: float = 3) -> DataFrame:
    """Density of one column; equal values are folded before the kernels."""
    spots = values.groupBy(F.col(col).cast("double").alias("x")).agg(F.count("*").cast("double").alias("weight"))
    return _kde(stage(spots.withColumn("y", F.lit(0.0))), grid, cut, 1).drop("iy", "gy")


def silhouette_time(members: DataFrame, t: str = "outage_time", *, label: str = "label", width: int = DAY) -> DataFrame:
    """Mean silhouette of a clustering by time, noise counting as one cluster.

    Time clusters do not overlap, so the nearest other cluster is the one before
    or after, or the noise; and sums of absolute differences come from running
    sums. No pair of rows is formed.
    """
    nodes = members.groupBy(t, label).agg(F.count("*").alias("n"))
    nodes = nodes.withColumn("s", F.col("n") * F.col(t)).withColumn("noise", F.col(label) == NOISE)
    nodes = stage(with_slice(nodes, F.col(t), width))

    clusters = nodes.groupBy(label).agg(F.sum("n").alias("size"), F.sum("s").alias("total"), F.min(t).alias("_t"))
    runs = with_slice(clusters.filter(F.col(label) != NOISE), F.col("_t"), width)
    runs = runs.withColumn("mean", F.col("total") / F.col("size"))
    runs = stage(neighbours(runs, ["_t"], previous={"mean_before": "mean"}, following={"mean_after": "mean"}))
    clusters = clusters.join(runs.select(label, "mean", "mean_before", "mean_after"), label, "left").drop("_t")

    rows = running(nodes, [t], "n", "sum", "own_n", keys=[label])
    rows = running(rows, [t], "s", "sum", "own_s", keys=[label])
    rows = rows.join(clusters, label)
    rows = rows.withColumn("noise_n", F.when(F.col("noise"), F.col("n")).otherwise(0))
    rows = rows.withColumn("noise_s", F.when(F.col("noise"), F.col("s")).otherwise(0))
    rows = stage(rows.withColumn("mark", F.when(~F.col("noise"), F.struct(F.col(label).alias("l"), "mean"))))
    rows = running(rows, [t, label], "noise_n", "sum", "out_n")
    rows = running(rows, [t, label], "noise_s", "sum", "out_s")
    rows = stage(rows)
    rows = running(rows, [t, label], "mark", "max", "back")
    rows = running(rows, [t, label], "mark", "min", "ahead", backward=True)

    def away(n, s, all_n, all_s):
        """Sum of absolute differences, from sums up to t and overall."""
        x = F.col(t)
        return x * n - s + (all_s - s) - x * (all_n - n)

    noise = nodes.agg(
        F.struct(
            F.sum(F.when(F.col("noise"), F.col("n"))).alias("n"), F.sum(F.when(F.col("noise"), F.col("s"))).alias("s")
        )
    ).scalar()
    own = away(F.col("own_n"), F.col("own_s"), F.col("size"), F.col("total"))
    inner = F.try_divide(own, F.col("size") - 1)
    to_noise = F.when(~F.col("noise"), F.try_divide(away(F.col("out_n"), F.col("out_s"), noise["n"], noise["s"]), noise["n"]))
    before = F.when(F.col("noise"), F.col("back.mean")).otherwise(F.col("mean_before"))
    after = F.when(F.col("noise"), F.col("ahead.mean")).otherwise(F.col("mean_after"))
    outer = F.least(to_noise, F.col(t) - before, after - F.col(t))
    score = F.when(F.col("size") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(outer - inner, F.greatest(outer, inner)), F.lit(0.0))
    )
    return rows.withColumn("score", score).agg(
        F.sum("n").alias("rows"),
        F.countDistinct(label).alias("labels"),
        (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("silhouette"),
    )
