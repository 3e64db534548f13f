"""OPTICS clusters by steep areas: hand-computed plots, and a plain version point by point."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from amperic.operators import clusters_time
from amperic.operators.kernels import PLOT_POINT, plot_points, reach_back, steep_clusters


def plain_order(t, min_samples, max_eps):
    """Order, reachability and predecessor of all rows, by always taking the nearest reached row."""
    n = len(t)
    core = [sorted(abs(x - y) for y in t)[min_samples - 1] if n >= min_samples else math.inf for x in t]
    core = [c if c <= max_eps else math.inf for c in core]
    reach, source, left, order = [math.inf] * n, [-1] * n, set(range(n)), []
    while left:
        i = min(left, key=lambda j: (reach[j], j))
        left.remove(i)
        order.append(i)
        for j in left:
            if core[i] < math.inf and abs(t[i] - t[j]) <= max_eps and max(core[i], abs(t[i] - t[j])) < reach[j]:
                reach[j], source[j] = max(core[i], abs(t[i] - t[j])), i
    return order, reach, source


def plain_xi(order, reach, source, xi, min_samples, least):
    """Labels (place of a cluster's first row, else -1) by comparing every steep-down area with every steep-up one."""
    n = len(order)
    r = [reach[i] for i in order] + [math.inf]
    place = {i: k for k, i in enumerate(order)}
    low = 1 - xi

    def way(k):
        a, b = r[k], r[k + 1]
        if a == b:
            return 0, False
        up = a < b
        ratio = (a / b if up else b / a) if max(a, b) < math.inf else 0.0
        return (1 if up else -1), ratio <= low + 1e-15

    areas, k = [], 0
    while k < n:
        side, steep = way(k)
        if not steep:
            k += 1
            continue
        end, flat, j = k, 0, k + 1
        while j < n:
            other, again = way(j)
            if other == -side:
                break
            if other == side and again:
                end, flat = j, 0
            else:
                flat += 1
                if flat > min_samples:
                    break
            j += 1
        areas.append((k, end, side))
        k = end + 1
    labels = [-1] * n
    for u, (first, last, side) in enumerate(areas):
        if side < 0:
            continue
        after = r[last + 1]
        for a, b, other in reversed(areas[:u]):
            if other > 0:
                continue
            top = max(r[b + 1 : first + 1])
            if top > r[a] * low or top > after * low or top == math.inf:
                continue
            s, e = a, last
            if r[a] * low >= after:
                while s < b and r[s + 1] > after:
                    s += 1
            elif after * low >= r[a]:
                while e > first and r[e - 1] > r[a]:
                    e -= 1
            while s < e and not r[s] > r[e] and not (source[order[e]] >= 0 and s <= place[source[order[e]]] < e):
                e -= 1
            if s >= e or e - s + 1 < least or e < first:
                continue
            if all(x == -1 for x in labels[s : e + 1]):
                labels[s : e + 1] = [s] * (e - s + 1)
    return labels


def plain(t, max_eps, min_samples, xi, least):
    t = sorted(t)
    order, reach, source = plain_order(t, min_samples, max_eps)
    assert order == list(range(len(t)))  # in one dimension the order is that of time
    labels = plain_xi(order, reach, source, xi, min_samples, least)
    return sorted((t[k], -1 if x < 0 else t[x]) for k, x in enumerate(labels))


def plotted(reach, source=None):
    points = np.zeros(len(reach), PLOT_POINT)
    points["t"] = points["at"] = np.arange(len(reach))
    points["reach"] = reach
    points["source"] = np.arange(len(reach)) - 1 if source is None else source
    points["weight"] = 1
    return points


@pytest.mark.parametrize(
    "reach,want",
    [
        # one valley: from the fall to the last low row; the level after it is too long for the rise
        ([math.inf, 1, 1, 1, 1, 5, 5, 5, 5, 5, 5], [(0, 4)]),
        # a shorter level belongs to the rise that ends with the plot
        ([math.inf, 1, 1, 1, 1, 5, 5], [(0, 6)]),
        # two valleys; the ridge between them is above both
        ([math.inf, 1, 1, 1, 9, 2, 2, 2, 9], [(0, 3), (4, 8)]),
        # a deeper valley inside a wide one is the cluster, the wide one around it is not
        ([math.inf] + [5] * 6 + [1] * 3 + [5] * 6 + [20] * 6, [(6, 9)]),
        # changes below a twentieth are not steep
        ([10, 9.9, 9.8, 9.9, 10], []),
        # the rise is cut where the valley's first value is passed
        ([4, 1, 1, 1, 2, 3, 6, 12], [(0, 6)]),
        # the fall is cut at the level that the valley ends on
        ([20, 12, 6, 1, 1, 1, 5, 5, 5, 5, 5], [(2, 5)]),
        ([math.inf] * 4, []),
        ([], []),
        ([math.inf], []),
        # zero distances
        ([math.inf, 0, 0, 0, 7, 7, 7, 7, 7], [(0, 3)]),
    ],
)
def test_by_hand(reach, want):
    assert steep_clusters(plotted(reach), xi=0.05, flat=3, least=3) == want


def test_last_row_must_be_reached_from_inside():
    reach = [math.inf, 1, 1, 1, 1.5, 2, 9]
    inside = plotted(reach)
    assert steep_clusters(inside, xi=0.05, flat=3, least=3) == [(0, 6)]
    level = plotted([2, 1, 1, 1, 1.5, 2, 9], source=[-1, 0, 1, 2, 3, -5, -5])
    assert steep_clusters(level, xi=0.05, flat=3, least=3) == [(0, 4)]


def seconds(rng, kind):
    if kind == "dense":
        return rng.integers(0, 60, 120)
    if kind == "bursts":
        return np.concatenate([rng.normal(c, s, n) for c, s, n in ((100, 3, 30), (400, 30, 40), (420, 2, 25), (2000, 100, 30))]).astype(int)
    if kind == "copies":
        return np.concatenate([np.full(40, 50), np.full(9, 51), rng.integers(0, 400, 25), np.full(30, 300)])
    return rng.integers(0, 10**6, 60)


def lines(t, max_eps, min_samples, xi, least):
    """The kernels alone, without Spark."""
    at, rows = np.unique(t, return_counts=True)
    copies = np.repeat(at, rows)
    core = np.array([np.sort(np.abs(copies - x))[min_samples - 1] if len(copies) >= min_samples else np.nan for x in at], float)
    core[core > max_eps] = np.nan
    reach, source = reach_back(at, core, max_eps)
    points = plot_points(at, rows, core, reach, at[source].astype(float), most=min_samples + 3)
    labels = np.full(len(points), -1)
    for a, b in steep_clusters(points, xi=xi, flat=min_samples, least=least):
        labels[a : b + 1] = points["t"][a]
    return sorted((int(p["t"]), int(x)) for p, x in zip(points, labels) for _ in range(p["weight"]))


@pytest.mark.parametrize("kind", ["dense", "bursts", "copies", "wide"])
def test_kernels_against_plain(kind):
    for seed in range(40):
        rng = np.random.default_rng(seed)
        t = seconds(rng, kind)
        max_eps = float(rng.choice([0.05, 0.3, 0.7, 10.0]) * max(t.std(), 1))
        min_samples, xi = int(rng.choice([2, 3, 5])), float(rng.choice([0.05, 0.2]))
        least = int(rng.choice([2, min_samples, 8]))
        assert lines(t, max_eps, min_samples, xi, least) == plain(t.tolist(), max_eps, min_samples, xi, least), seed


def test_on_spark(spark):
    rng = np.random.default_rng(3)
    period = 10_000
    parts = [seconds(rng, k) + p * period for p, k in enumerate(("bursts", "copies", "bursts"))]
    t = np.concatenate([[0], *parts])
    pdf = pd.DataFrame({"t": t.astype("int64"), "label": "x"})
    df = spark.createDataFrame(pdf).repartition(5).unionByName(spark.createDataFrame([(None, "y")], "t long, label string"))
    got = clusters_time.optics_xi(df, "t", period=period, max_eps=0.7)
    counted = {(r["period_no"], r["t"], r["label"]): r["rows"] for r in got.collect()}
    want: dict = {}
    for p in range(3):
        mine = t[t // period == p]
        for second, label in plain(mine.tolist(), 0.7 * mine.std(), 5, 0.05, 5):
            want[p, second, label] = want.get((p, second, label), 0) + 1
    assert counted == want
    assert sum(label >= 0 for _, _, label in want) > 5


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "outage_time bigint")
    assert clusters_time.optics_xi(empty).count() == 0
    one = spark.createDataFrame([(5,)] * 3, "outage_time bigint")
    assert [tuple(r) for r in clusters_time.optics_xi(one).collect()] == [(0, 5, -1, 3)]
    copies = clusters_time.optics_xi(spark.range(200).select(F.lit(7).cast("bigint").alias("outage_time")))
    assert [tuple(r) for r in copies.collect()] == [(0, 7, 7, 200)]
