"""DBSCAN in range partitions that each hold what surrounds them.

Cells are laid along a space-filling curve and cut into parts of about equal numbers of
points. A part gets its own cells and, as a halo, the cells around them, so one shuffle
brings together all that is needed to tell which of its points are core and which of
its cells belong together. What is left is a graph between cells of different parts.

Only in one place may a part need to know whether a halo point is core: where that
point's cell is thin. Such links name the point and are settled when its own part has
told.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperic.operators.kernels import near_cells
from amperic.operators.ordered import even_slices, running
from amperic.operators.reach import Axes, columns
from amperic.session import stage

CORE, LINK, MAYBE_LINK, BORDER, MAYBE_BORDER = range(5)


def offsets(metric: Sequence[Axes]) -> list[tuple[int, ...]]:
    """All other cells that may hold a neighbour."""
    ranges = [range(-r, r + 1) for axes in metric for r in [math.ceil(math.sqrt(len(axes.cols)))] * len(axes.cols)]
    return [o for o in product(*ranges) if any(o)]


def _curve(cell: Column, least: Sequence[int]) -> list[Column]:
    """Place of a cell along a Z-order curve, from its lowest bits interleaved."""
    d = len(least)
    bits = 63 // d
    apart = [F.get(cell, F.lit(i)) - F.lit(low) for i, low in enumerate(least)]
    far = F.array(*[F.shiftright(a, bits) for a in apart])
    near = F.lit(0).cast("bigint")
    for b in range(bits):
        for i, a in enumerate(apart):
            near = near + F.shiftleft(F.shiftright(a, b).bitwiseAND(F.lit(1).cast("bigint")), b * d + i)
    return [far.alias("_far"), near.alias("_near")]


def parts(census: DataFrame, metric: Sequence[Axes], size: int) -> DataFrame:
    """``cell``, ``node``, ``part`` and ``own``: the cells of each part and its halo.

    ``census`` has a row per ``cell`` with ``node`` (its least point) and ``k`` points.
    """
    d = len(columns(metric))
    seen = census.agg(F.sum("k").alias("k"), F.array(*[F.min(F.get("cell", F.lit(i))) for i in range(d)]).alias("least")).first()
    whole = census.select("cell", "node", F.lit(0).cast("bigint").alias("part"), F.lit(True).alias("own"))
    if (seen["k"] or 0) <= size:
        return whole
    by = ["_far", "_near"]
    laid = census.select("cell", "node", "k", *_curve(F.col("cell"), seen["least"]))
    laid = stage(even_slices(stage(laid), [], by))
    home = running(laid, by, "k", "sum", "_upto")
    home = stage(home.select("cell", "node", F.floor((F.col("_upto") - F.col("k")) / size).alias("part")))
    table = F.expr(f"array({', '.join('array(' + ', '.join(f'{v}L' for v in o) + ')' for o in offsets(metric))})")
    around = home.select("part", F.col("cell").alias("_from"), F.explode(table).alias("_o"))
    around = around.select("part", F.zip_with("_from", "_o", lambda a, b: a + b).alias("cell")).distinct()
    # never broadcast: the planner takes this side to be as small as the cells it was exploded from
    halo = around.hint("merge").join(home.select("cell", "node", F.col("part").alias("_home")), "cell")
    halo = halo.filter("part <> _home").select("cell", "node", "part", F.lit(False).alias("own"))
    return home.select("cell", "node", "part", F.lit(True).alias("own")).unionByName(halo)


def partwise(points: DataFrame, census: DataFrame, metric: Sequence[Axes], min_samples: int, size: int) -> DataFrame:
    """``kind``, ``a``, ``b``, ``n``, staged:

    * CORE: the core point ``a`` of cell ``b``, with its weight,
    * LINK: cells ``a`` and ``b`` belong together,
    * MAYBE_LINK: cell ``a`` and the cell of point ``b`` do if that point is core,
    * BORDER, MAYBE_BORDER: point ``a``, itself not core, and a cell or point near it.

    Cells are named by their least point. ``points`` has ``cell``, the axes, ``pid``,
    ``n`` and ``far`` (the weight of neighbours known from elsewhere).
    """
    names = columns(metric)
    d = len(names)
    axes, at = [], 0
    for a in metric:
        axes.append((list(range(at, at + len(a.cols))), a.eps))
        at += len(a.cols)
    around = np.array(offsets(metric), np.int64)
    shipped = points.join(parts(census, metric, size), "cell").select(
        "part", "own", "node", "pid", "n", "far", *[F.get("cell", F.lit(i)).alias(f"_c{i}") for i in range(d)], *[F.col(c).alias(f"_x{i}") for i, c in enumerate(names)]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = near_cells(
            pdf[[f"_c{i}" for i in range(d)]].to_numpy(np.int64),
            pdf[[f"_x{i}" for i in range(d)]].to_numpy(float),
            *(pdf[c].to_numpy() for c in ("pid", "n", "far", "own", "node")),
            axes=axes, around=around, min_samples=min_samples,
        )
        kinds = np.repeat(range(5), [len(a) for a, _, _ in found])
        return pd.DataFrame({"kind": kinds, **{c: np.concatenate([f[i] for f in found]) for i, c in enumerate("abn")}})

    return stage(shipped.groupBy("part").applyInPandas(solve, "kind int, a bigint, b bigint, n bigint"))
