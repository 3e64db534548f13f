"""Convex hulls of clusters, what lies inside them, and their areas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperic.functions.geo import albers, utm
from amperic.functions.scaling import percent
from amperic.operators.clusters_time import NOISE
from amperic.operators.kernels import hull_of, maybe_corners, starts_of, whole_groups
from amperic.operators.ordered import neighbours, with_slice
from amperic.operators.snapshots import outage_minute
from amperic.functions.clock import DAY
from amperic.session import stage

# Cross products up to this size count as zero: points on one line.
TOLERANCE = 1e-12


def convex_hulls(points: DataFrame, keys: Sequence[str], *, x: str = "location_longitude", y: str = "location_latitude", tol: float = TOLERANCE) -> DataFrame:
    """Hull corners per key as arrays ``hx``, ``hy``, counter-clockwise.

    A hull of hulls is the hull. Every task first reduces each batch of its points
    to partial hulls, so a key of any size reaches its final task as a few corners
    per batch. One or two places are their own hull; points without a place count
    for nothing.
    """
    keys = list(keys)
    spots = points.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        """Without the points that are plainly no corners."""
        return pdf[maybe_corners(pdf["x"].to_numpy(), pdf["y"].to_numpy(), starts_of(pdf, keys), tol)]

    def corners(pdf: pd.DataFrame, starts: np.ndarray) -> list[np.ndarray]:
        px, py = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        stops = np.append(starts[1:], len(pdf))
        return [
            a + (hull_of(px[a:b], py[a:b], tol) if b - a > 2 else np.lexsort((py[a:b], px[a:b]))) for a, b in zip(starts, stops)
        ]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates().sort_values(keys, ignore_index=True)
            if len(pdf):
                pdf = outer(pdf)
                size = np.diff(np.append(starts_of(pdf, keys), len(pdf)))
                many = np.repeat(size > 2, size)
                few, pdf = pdf[~many], pdf[many]
                yield few if pdf.empty else pd.concat([few, pdf.iloc[np.concatenate(corners(pdf, starts_of(pdf, keys)))]])

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, _ in whole_groups(batches, keys):
            pdf = outer(pdf.drop_duplicates())
            starts = starts_of(pdf, keys)
            px, py = pdf["x"].to_numpy(), pdf["y"].to_numpy()
            at = corners(pdf, starts)
            yield pdf[keys].iloc[starts].assign(hx=[px[i] for i in at], hy=[py[i] for i in at])

    types = {f.name: f.dataType.simpleString() for f in spots.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", hx array<double>, hy array<double>"
    thin = spots.mapInPandas(partial, spots.schema).repartition(*keys).sortWithinPartitions(*keys)
    return thin.mapInPandas(final, schema)


def strictly_inside(px: Column, py: Column, hx: Column, hy: Column, tol: float = TOLERANCE) -> Column:
    """Whether a point is inside a hull, its boundary excluded.

    The hull of one place holds that place, the hull of two the open segment.
    """
    n = F.size(hx)
    at = lambda i: (F.get(hx, i), F.get(hy, i))

    def cross(i, j):
        (ax, ay), (bx, by) = at(i), at(j)
        return (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    polygon = F.forall(F.sequence(F.lit(0), n - 1), lambda i: cross(i, (i + 1) % n) > tol)
    (ax, ay), (bx, by) = at(F.lit(0)), at(F.lit(1))
    along = (px - ax) * (bx - ax) + (py - ay) * (by - ay)
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    segment = (F.abs(cross(F.lit(0), F.lit(1))) <= tol) & (along > tol) & (along < length - tol)
    place = (px == ax) & (py == ay)
    return F.when(n >= 3, polygon).when(n == 2, segment).otherwise(place)


def ring_area(hx: Column, hy: Column) -> Column:
    """Area of a closed ring by the shoelace formula."""
    n = F.size(hx)

    def add(total, i):
        j = (i + 1) % n
        return total + F.get(hx, i) * F.get(hy, j) - F.get(hx, j) * F.get(hy, i)

    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), add)) / 2


def projected(hx: Column, hy: Column, project) -> tuple[Column, Column]:
    """Ring corners under a projection taking ``(lat, lon)``."""
    spots = F.transform(
        F.arrays_zip(hx.alias("lon"), hy.alias("lat")),
        lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", project(p["lat"], p["lon"]))]),
    )
    return spots["x"], spots["y"]


def hull_areas(hulls: DataFrame) -> DataFrame:
    """Adds the hull area in square degrees and in square metres two ways."""
    hx, hy = F.col("hx"), F.col("hy")
    return hulls.select(
        *[c for c in hulls.columns if c not in ("hx", "hy")],
        F.size(hx).alias("corners"),
        ring_area(hx, hy).alias("area_degrees"),
        ring_area(*projected(hx, hy, albers)).alias("area_albers_m2"),
        ring_area(*projected(hx, hy, utm)).alias("area_utm_m2"),
    )


def percent_area_out(places: DataFrame) -> DataFrame:
    """Per minute, hull area of outage places in percent of outage plus powered
    hull area. ``places`` comes from ``snapshots.minute_places``."""
    areas = hull_areas(convex_hulls(places, ["minute", "kind"], x="lon", y="lat"))
    per = areas.groupBy("minute").agg(
        F.max(F.when(F.col("kind") == "outage", F.col("area_albers_m2"))).alias("outage_m2"),
        F.max(F.when(F.col("kind") == "powered", F.col("area_albers_m2"))).alias("powered_m2"),
    )
    return per.withColumn("percent_area_out", percent(F.col("outage_m2"), F.col("powered_m2")))


def _cluster_minutes(members: DataFrame, label: str, t: str) -> DataFrame:
    return members.filter(F.col(label) != NOISE).select(label, outage_minute(t).alias("minute")).distinct()


def powered_counts(members: DataFrame, snapshot: DataFrame, *, label: str = "label", t: str = "outage_time") -> DataFrame:
    """Per cluster, the sensors powered at some member's minute that are no
    members. Meant for clusters by time, where a minute belongs to one cluster."""
    seen = _cluster_minutes(members, label, t).join(snapshot, "minute").select(label, "core_id").distinct()
    others = seen.join(members.select(label, "core_id").distinct(), [label, "core_id"], "left_anti")
    return others.groupBy(label).agg(F.count("*").alias("num_powered"))


def powered_near(
    members: DataFrame,
    shapes: DataFrame,
    snapshot: DataFrame,
    *,
    label: str = "label",
    t: str = "outage_time",
    cell_degrees: float = 0.03,
    factor: int = 4,
    levels: int = 8,
) -> DataFrame:
    """Powered sensors around each cluster, members left out: one row per cluster
    and sensor with the sensor's latest place.

    A hull is looked up in cells at least as wide as it is, of which it touches at
    most four, so a wide hull over many minutes costs no more rows than a narrow
    one. Cell widths grow by ``factor`` over ``levels`` sizes, and sensors are
    listed at the sizes in use. Every sensor in a hull's bounding box is found.
    """
    sizes = [cell_degrees * factor**k for k in range(levels)]

    def cell(c, size):
        return F.floor(c / size).cast("bigint")

    ends = {f"_{k}{a}": f(f"h{a}") for a in "xy" for k, f in (("lo", F.array_min), ("hi", F.array_max))}
    boxes = shapes.select(label, *[c.alias(n) for n, c in ends.items()])
    extent = F.greatest(F.col("_hix") - F.col("_lox"), F.col("_hiy") - F.col("_loy"))
    level = sum((F.when(extent > s, 1).otherwise(0) for s in sizes[:-1]), F.lit(0))
    boxes = boxes.withColumn("_level", level)
    width = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("_level") + 1)
    boxes = stage(boxes.withColumn("_width", width))
    used = boxes.select("_level", "_width").distinct().limit(levels).collect()
    for a in "xy":
        boxes = boxes.withColumn(f"_c{a}", F.explode(F.sequence(cell(F.col(f"_lo{a}"), F.col("_width")), cell(F.col(f"_hi{a}"), F.col("_width")))))
    minutes = stage(_cluster_minutes(members, label, t))
    lon, lat = F.col("location_longitude"), F.col("location_latitude")
    cells = [
        F.struct(F.lit(r["_level"]).alias("_level"), cell(lon, r["_width"]).alias("_cx"), cell(lat, r["_width"]).alias("_cy")) for r in used
    ] or [F.struct(F.lit(0).alias("_level"), cell(lon, sizes[0]).alias("_cx"), cell(lat, sizes[0]).alias("_cy"))]
    spots = snapshot.withColumn("_cell", F.explode(F.array(*cells))).select("minute", "core_id", "_cell.*", lon.alias("_x"), lat.alias("_y"))
    near = minutes.join(boxes, label).join(spots, ["minute", "_level", "_cx", "_cy"])
    near = near.filter(F.col("_x").between(F.col("_lox"), F.col("_hix")) & F.col("_y").between(F.col("_loy"), F.col("_hiy")))
    near = near.select(label, "core_id").distinct()
    near = near.join(members.select(label, "core_id").distinct(), [label, "core_id"], "left_anti")
    return near.join(minutes, label).join(snapshot, ["minute", "core_id"]).groupBy(label, "core_id").agg(
        F.max_by("location_latitude", "minute").alias("location_latitude"),
        F.max_by("location_longitude", "minute").alias("location_longitude"),
    )


def powered_in_hull(members: DataFrame, snapshot: DataFrame, *, label: str = "label", t: str = "outage_time") -> DataFrame:
    """Per cluster: size, distinct powered places strictly inside the hull, and
    these in percent of themselves plus the members."""
    rows = members.filter(F.col(label) != NOISE)
    sizes = rows.groupBy(label).agg(F.count("*").alias("cluster_size"))
    shapes = stage(convex_hulls(rows, [label]))
    spots = powered_near(rows, shapes, snapshot, label=label, t=t)
    spots = spots.select(label, "location_longitude", "location_latitude").distinct()
    inside = spots.join(shapes, label).filter(
        strictly_inside(F.col("location_longitude"), F.col("location_latitude"), F.col("hx"), F.col("hy"))
    )
    inside = inside.groupBy(label).agg(F.count("*").alias("powered_inside"))
    out = sizes.join(inside, label, "left").fillna(0, ["powered_inside"])
    return out.withColumn(
        "percent_powered_inside",
        F.col("powered_inside") / (F.col("powered_inside") + F.col("cluster_size")) * 100,
    )


def listed_area(points: DataFrame, key: str, order: Sequence[str], *, x: str = "location_longitude", y: str = "location_latitude", width: int = DAY) -> DataFrame:
    """Shoelace area of each key's points joined up in the given order (first
    order column in seconds), in square degrees."""
    rows = with_slice(points.select(key, *order, x, y), F.col(order[0]), width)
    rows = neighbours(rows, order, keys=[key], following={"_nx": x, "_ny": y})
    at = F.struct(*order)
    start = points.groupBy(key).agg(F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), at).alias("_s"))
    rows = rows.join(start, key)
    nx, ny = F.coalesce("_nx", "_s.x"), F.coalesce("_ny", "_s.y")
    return rows.groupBy(key).agg(
        (F.abs(F.sum(F.col(x) * ny - nx * F.col(y))) / 2).alias("listed_area")
    )
