"""Density clustering in several dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.functions.scaling import zscore
from amperic.operators.clusters_time import NOISE
from amperic.operators.components import components, linked
from amperic.operators.halo import BORDER, CORE, LINK, MAYBE_BORDER, MAYBE_LINK, partwise
from amperic.operators.ordered import islands
from amperic.operators.reach import Axes, boxes, cell, cell_pairs, columns, within_reach
from amperic.operators.topology import prepared
from amperic.session import stage


def dbscan(
    rows: DataFrame,
    metric: Sequence[Axes],
    min_samples: int,
    *,
    id_col: str = "event_id",
    label: str = "label",
    crowded: int = 1000,
    part: int = 20_000,
) -> DataFrame:
    """DBSCAN where a neighbour is within reach on every axes group.

    The neighbourhood is closed and counts the row itself. A label is the least
    id among the cluster's core rows, noise is -1, and a border row takes the
    lowest label it can reach. A row without a place is noise.

    Cells are small enough that rows sharing one are neighbours. So a cell with
    ``min_samples`` rows is core as a whole, and clusters are components of cells. Parts
    of about ``part`` distinct places, each with the cells around it, are solved in one
    task each (see ``halo``); then the links between parts are joined.

    A cell with more than ``crowded`` distinct places would be copied into too many parts.
    Such cells are compared with those around them by boxes, which are split only where
    undecided (see ``reach``).
    """
    names = columns(metric)
    placed = F.lit(True)
    for c in names:
        placed = placed & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    points = rows.filter(placed).groupBy(*[F.col(c).cast("double").alias(c) for c in names]).agg(
        F.min(id_col).alias("pid"), F.count("*").alias("n")
    )
    points = stage(points.withColumn("cell", cell(metric)))
    census = stage(points.groupBy("cell").agg(F.min("pid").alias("node"), F.count("*").alias("k"), F.sum("n").alias("n")))
    crowded = max(crowded, min_samples)  # a crowded cell is core as a whole
    full = census.filter(F.col("k") > crowded)
    any_full = not full.isEmpty()
    plain = points.withColumn("far", F.lit(0).cast("bigint"))
    if any_full:
        far = _counted_in_full(points, census, full, metric, min_samples)
        plain = points.join(far, "pid", "left").withColumn("far", F.coalesce("far", F.lit(0).cast("bigint")))
    told = partwise(plain, census.filter(F.col("k") <= crowded), metric, min_samples, part)
    of = lambda kind: told.filter(F.col("kind") == kind)
    core = of(CORE).select(F.col("a").alias("pid"), F.col("b").alias("node"), "n")
    if any_full:
        inside = points.join(full.select("cell", "node"), "cell").select("pid", "node", "n")
        core = stage(core.unionByName(inside))
    home = core.select(F.col("pid").alias("b"), F.col("node").alias("_home"))
    settle = lambda kind: of(kind).join(home, "b").select("a", F.col("_home").alias("b"))
    links = of(LINK).select("a", "b").unionByName(settle(MAYBE_LINK))
    border = of(BORDER).select("a", "b").unionByName(settle(MAYBE_BORDER)) if min_samples > 2 else None
    if any_full:
        more_links, more_border = _linked_to_full(points, core, full, metric, min_samples)
        links = links.unionByName(more_links)
        border = border.unionByName(more_border) if min_samples > 2 else None
    roots = linked(links)
    members = core.join(roots, "node", "left").select("pid", "n", F.coalesce("root", "node").alias("root"))
    sizes = members.groupBy("root").agg(F.min("pid").alias(label), F.sum("n").alias("_size"))
    labels = members.join(sizes, "root")
    if min_samples <= 2:
        labels = labels.filter(F.col("_size") >= min_samples)
    labels = labels.select("pid", label)
    if border is not None:
        reached = border.select(F.col("a").alias("pid"), F.col("b").alias("node")).join(roots, "node", "left")
        reached = reached.select("pid", F.coalesce("root", "node").alias("root")).join(sizes.select("root", label), "root")
        labels = labels.unionByName(reached.groupBy("pid").agg(F.min(label).alias(label)))
    match = [f"_at{i}" for i in range(len(names))]
    labels = points.join(labels, "pid").select(*[F.col(c).alias(m) for c, m in zip(names, match)], label)
    keyed = rows.select(*rows.columns, *[F.col(c).cast("double").alias(m) for c, m in zip(names, match)])
    return keyed.join(labels, match, "left").select(*rows.columns, F.coalesce(label, F.lit(NOISE)).alias(label))


def _as_boxes(points: DataFrame, names: Sequence[str]) -> DataFrame:
    at = F.array(*[F.col(c) for c in names])
    return points.select(
        "cell", F.col("pid").alias("id"), "n", at.alias("lo"), at.alias("hi"), F.array(at).alias("ends")
    )


def _counted_in_full(points: DataFrame, census: DataFrame, full: DataFrame, metric: Sequence[Axes], min_samples: int) -> DataFrame:
    """``pid``, ``far``: weight within reach in crowded cells, for points of thin cells."""
    inside = points.join(full.select("cell"), "cell", "left_semi")
    thin = points.join(census.filter(F.col("n") < min_samples).select("cell"), "cell", "left_semi")
    pairs = cell_pairs(_as_boxes(thin, columns(metric)), stage(boxes(inside, metric, ["cell"])), metric, forward=False)
    near = within_reach(pairs, None, inside, metric, count_to=min_samples)
    return near.select(F.col("left_id").alias("pid"), F.col("near").alias("far"))


def _linked_to_full(
    points: DataFrame, core: DataFrame, full: DataFrame, metric: Sequence[Axes], min_samples: int
) -> tuple[DataFrame, DataFrame | None]:
    """Links (``a``, ``b``) between cells with a core point and crowded cells, and the
    crowded cells that points without core are near to."""
    node = core.select(F.col("pid").alias("_pid"), F.col("node").alias("_node"))
    dense = stage(points.join(core.select("pid"), "pid", "left_semi"))
    cells = stage(boxes(dense, metric, ["cell"]))
    crowds = cells.join(full.select("cell"), "cell", "left_semi")
    linked_ = within_reach(cell_pairs(cells, crowds, metric, forward=False), dense, dense, metric, merge=True)
    for side, name in (("left_id", "a"), ("right_id", "b")):
        linked_ = linked_.join(node, F.col(side) == F.col("_pid")).drop(side, "_pid").withColumnRenamed("_node", name)
    if min_samples <= 2:
        return linked_.select("a", "b"), None
    edge = points.join(core.select("pid"), "pid", "left_anti")
    near = within_reach(cell_pairs(_as_boxes(edge, columns(metric)), crowds, metric, forward=False), None, dense, metric)
    near = near.join(node, F.col("right_id") == F.col("_pid")).select(F.col("left_id").alias("a"), F.col("_node").alias("b"))
    return linked_.select("a", "b"), near


def st_dbscan(
    rows: DataFrame,
    *,
    t: str = "outage_time",
    lat: str = "location_latitude",
    lon: str = "location_longitude",
    spatial_eps: float = 0.03,
    temporal_eps: float = 90,
    min_neighbors: int = 1,
    id_col: str = "event_id",
    label: str = "label",
) -> DataFrame:
    """Spatio-temporal DBSCAN: near in degrees and near in seconds.

    ``min_neighbors`` does not count the row itself.
    """
    metric = [Axes((lon, lat), float(spatial_eps)), Axes((t,), float(temporal_eps))]
    return dbscan(rows, metric, min_neighbors + 1, id_col=id_col, label=label)


def dbscan_features(
    rows: DataFrame,
    cols: Sequence[str] = ("outage_time", "location_latitude", "location_longitude"),
    *,
    eps: float = 0.65,
    min_samples: int = 5,
    weights: Mapping[str, float] | None = None,
    id_col: str = "event_id",
    label: str = "label",
) -> DataFrame:
    """DBSCAN on z-scored features, optionally weighted per column."""
    scaled = stage(zscore(rows, cols, weights))
    metric = [Axes(tuple(f"z_{c}" for c in cols), float(eps))]
    return dbscan(scaled, metric, min_samples, id_col=id_col, label=label).drop(*[f"z_{c}" for c in cols])


def grid_dbscan(
    rows: DataFrame,
    topology: DataFrame,
    *,
    max_distance: int = 1,
    t: str = "outage_time",
    temporal_eps: float = 90,
    id_col: str = "event_id",
    label: str = "label",
) -> DataFrame:
    """Outages near in time whose sensors are at most ``max_distance`` apart on
    the grid (1 transformer, 2 feeder, 3 substation), one neighbour suffices.

    Sharing a level is membership of a group, so the neighbours along one level
    are time runs inside its group. A row belongs to one run per level; runs that
    share a row are one cluster.
    """
    levels = ["core_id", "transformer", "feeder", "substation"][: max_distance + 1]
    grid = prepared(topology).filter("end_time >= start_time")
    at = F.timestamp_seconds(t)
    placed = rows.join(grid, "core_id").filter(at.between(F.col("start_time"), F.col("end_time")))
    tags = [F.concat(F.lit(f"{level}="), F.col(level).cast("string")) for level in levels]
    tagged = stage(placed.select(F.col(id_col).alias("_id"), t, F.explode(F.array(*tags)).alias("_group")))
    runs = stage(tagged.join(islands(tagged, t, temporal_eps, keys=["_group"]), ["_group", t]))
    # a run is named by its least row, a row by its least run
    runs = runs.join(
        runs.groupBy("_group", "island").agg(F.min("_id").alias("_run")), ["_group", "island"]
    ).select("_id", "_run")
    home = runs.groupBy("_id").agg(F.min("_run").alias("_home"))
    roots = components(runs.join(home, "_id").select("_run", "_home"), a="_run", b="_home")
    found = home.join(roots, F.col("_home") == F.col("node"), "left").select(
        F.col("_id").alias(id_col), F.coalesce("root", "_home").alias(label)
    )
    sizes = found.groupBy(label).agg(F.count("*").alias("_size"))
    found = found.join(sizes, label).select(
        id_col, F.when(F.col("_size") > 1, F.col(label)).otherwise(F.lit(NOISE)).alias(label)
    )
    return rows.join(found, id_col, "left").withColumn(label, F.coalesce(label, F.lit(NOISE)))
