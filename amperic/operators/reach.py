"""Which boxes of points lie within reach of each other.

Comparing every point of one cell with every point of the next is quadratic
where points are dense. Boxes are compared instead: two boxes are surely within
reach, surely not, or are split into smaller boxes and compared again. A box
around a single point is always decided.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperic.operators.components import components
from amperic.session import stage

# Finer cells per axis and level. Two keep the pairs a split makes few where
# points are dense and most pairs are settled one level down.
SPLIT = 2


@dataclass(frozen=True)
class Axes:
    """Columns measured together (Euclidean) and how far a neighbour may be."""

    cols: tuple[str, ...]
    eps: float

    @property
    def side(self) -> float:
        """Cell side for which points sharing a cell are within reach."""
        k = len(self.cols)
        return self.eps if k == 1 else self.eps / math.sqrt(k) * (1 - 1e-9)


def columns(metric: Sequence[Axes]) -> list[str]:
    return [c for axes in metric for c in axes.cols]


def _sides(metric: Sequence[Axes]) -> list[float]:
    return [axes.side for axes in metric for _ in axes.cols]


def cell(metric: Sequence[Axes], level: int = 0, finer: int = SPLIT) -> Column:
    """Cell coordinates of a point; each level is ``finer`` times finer."""
    return F.array(
        *[
            F.floor(F.col(c) / F.lit(side / finer**level)).cast("bigint")
            for c, side in zip(columns(metric), _sides(metric))
        ]
    )


def boxes(points: DataFrame, metric: Sequence[Axes], by: Sequence[str], edges: bool = True) -> DataFrame:
    """Bounding box (``lo``, ``hi``), point id and weight per group, with the
    points that touch the box (``ends``, two per axis; none without ``edges``)."""
    names = columns(metric)
    at = F.array(*names)
    box = [
        F.min("pid").alias("id"),
        F.sum("n").alias("n"),
        F.array(*[F.min(c) for c in names]).alias("lo"),
        F.array(*[F.max(c) for c in names]).alias("hi"),
    ]
    if edges:
        ends = F.array(*[pick(at, c) for c in names for pick in (F.min_by, F.max_by)])
        return points.groupBy(*by).agg(*box, ends.alias("ends"))
    return points.groupBy(*by).agg(*box).withColumn("ends", F.lit(None).cast("array<array<double>>"))


BOX = ("id", "n", "lo", "hi", "ends")


def _dist(metric: Sequence[Axes], length) -> Column:
    """True where every axes group is within its reach, for per-axis lengths."""
    ok, i = F.lit(True), 0
    for axes in metric:
        parts = [length(i + k) for k in range(len(axes.cols))]
        i += len(parts)
        if len(parts) == 1:
            ok = ok & (parts[0] <= axes.eps)
        else:
            ok = ok & (sum((p * p for p in parts[1:]), parts[0] * parts[0]) <= axes.eps * axes.eps)
    return ok


def _gap(a_lo, a_hi, b_lo, b_hi):
    return lambda i: F.greatest(b_lo[i] - a_hi[i], a_lo[i] - b_hi[i], F.lit(0.0))


def _span(a_lo, a_hi, b_lo, b_hi):
    return lambda i: F.greatest(b_hi[i] - a_lo[i], a_hi[i] - b_lo[i])


def cell_pairs(left: DataFrame, cells: DataFrame, metric: Sequence[Axes], *, forward: bool) -> DataFrame:
    """Left boxes with the boxes of surrounding cells that may hold a neighbour.

    ``left`` and ``cells`` have ``cell`` and the fields of a box. With
    ``forward`` each pair of cells is met once. A surrounding cell beyond the
    reach of the left box is dropped before the join.
    """
    ranges = [range(-r, r + 1) for axes in metric for r in [math.ceil(math.sqrt(len(axes.cols)))] * len(axes.cols)]
    zero = (0,) * len(ranges)
    offsets = [o for o in product(*ranges) if (o > zero if forward else o != zero)]
    table = F.expr(f"array({', '.join('array(' + ', '.join(f'{v}L' for v in o) + ')' for o in offsets)})")
    around = left.select(
        F.struct(*BOX).alias("a"), F.col("cell").alias("left_cell"), F.explode(table).alias("_o")
    )
    around = around.withColumn("right_cell", F.zip_with("left_cell", "_o", lambda x, y: x + y)).drop("_o")

    there = F.col("right_cell")
    slack = [Axes(axes.cols, axes.eps * (1 + 1e-6)) for axes in metric]
    sides = _sides(metric)
    floor = [there[i] * sides[i] for i in range(len(sides))]
    ceil = [(there[i] + 1) * sides[i] for i in range(len(sides))]
    around = around.filter(_dist(slack, _gap(F.col("a.lo"), F.col("a.hi"), floor, ceil)))

    other = cells.select(F.col("cell").alias("right_cell"), F.struct(*BOX).alias("b"))
    # never broadcast: the planner does not know what the explosion made of the left boxes
    return around.hint("merge").join(other, "right_cell").select(
        F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), "a", "b", "left_cell", "right_cell"
    )


def within_reach(
    pairs: DataFrame,
    left_points: DataFrame | None,
    right_points: DataFrame,
    metric: Sequence[Axes],
    *,
    count_to: int | None = None,
    merge: bool = False,
) -> DataFrame:
    """Decide ``pairs`` of boxes (from :func:`cell_pairs`).

    Without ``count_to``: the ``(left_id, right_id)`` that hold at least one pair
    of points within reach. With ``merge``, where both ids name cells, pairs whose
    cells are already connected by other pairs are left out: the components are
    those of all pairs. With ``count_to`` (left boxes being single points): ``left_id``
    and ``near``, the weight of right points within reach; exact below
    ``count_to``, and at least that where there are as many.

    ``left_points`` is None where left boxes are single points. Two boxes are
    linked at once when points on their edges are, which settles nearly all pairs
    where points are dense. Every level splits only boxes still undecided.
    """
    def touching(a, b):
        near = lambda p, q: _dist(metric, lambda i: F.abs(p[i] - q[i]))
        return F.exists(a["ends"], lambda p: F.exists(b["ends"], lambda q: near(p, q)))

    frontier = pairs.select("left_id", "right_id", "a", "b", "left_cell", "right_cell")
    found, level = None, 0
    while True:
        a, b = F.col("a"), F.col("b")
        box = (a["lo"], a["hi"], b["lo"], b["hi"])
        sure = _dist(metric, _span(*box))
        if count_to is None:
            sure = F.when(sure, F.lit(True)).otherwise(touching(a, b))
        judged = frontier.filter(_dist(metric, _gap(*box))).withColumn("_sure", sure)
        judged = stage(judged)
        sure = judged.filter("_sure")
        if count_to is None:
            sure = sure.select("left_id", "right_id").distinct()
        else:
            sure = sure.groupBy("left_id").agg(F.sum("b.n").alias("near"))
        found = sure if found is None else found.unionByName(sure)
        open_ = judged.filter("not _sure").drop("_sure")
        if open_.isEmpty():
            break
        if count_to is None:
            open_ = open_.join(sure, ["left_id", "right_id"], "left_anti")
            if merge:
                found = stage(found)
                root = components(found, a="left_id", b="right_id")
                for side in ("left", "right"):
                    name = root.select(F.col("node").alias(f"{side}_id"), F.col("root").alias(f"_{side}"))
                    open_ = open_.join(name, f"{side}_id", "left")
                open_ = open_.filter("_left is null or _right is null or _left <> _right").drop("_left", "_right")
        else:
            found = stage(found.groupBy("left_id").agg(F.sum("near").alias("near")))
            open_ = open_.join(found.filter(F.col("near") >= count_to), "left_id", "left_anti")
        frontier = split(open_, right_points, "b", "right", metric, level, edges=count_to is None)
        if left_points is not None:
            frontier = split(frontier, left_points, "a", "left", metric, level)
        level += 1
    if count_to is not None:
        return found.groupBy("left_id").agg(F.sum("near").alias("near"))
    return found.distinct()


def split(
    pairs: DataFrame,
    points: DataFrame,
    name: str,
    side: str,
    metric: Sequence[Axes],
    level: int,
    finer: int = SPLIT,
    edges: bool = True,
) -> DataFrame:
    """Replace one side's boxes by the boxes of the next finer cells."""
    key = f"{side}_cell"
    wanted = pairs.select(F.col(key).alias("_cell")).distinct()
    inside = points.withColumn("_cell", cell(metric, level, finer)).join(wanted, "_cell")
    parts = boxes(inside.withColumn("_finer", cell(metric, level + 1, finer)), metric, ["_cell", "_finer"], edges)
    parts = parts.select(
        F.col("_cell").alias(key), F.col("_finer"), F.struct(*BOX).alias("_box")
    )
    return pairs.drop(name).join(parts, key).drop(key).withColumnsRenamed({"_finer": key, "_box": name})
