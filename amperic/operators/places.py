"""Nearest places, exactly, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.session import stage

DEEPEST = 24  # halvings of the extent at most
RINGS = 3  # levels that an ask looks at in one step


def _squared(lo: Column, hi: Column, x: str, y: str) -> tuple[Column, Column]:
    """Squared distances to the nearest and the farthest place a box may hold."""
    gap = [F.greatest(lo[i] - F.col(c), F.col(c) - hi[i], F.lit(0.0)) for i, c in enumerate((x, y))]
    far = [F.greatest(F.col(c) - lo[i], hi[i] - F.col(c)) for i, c in enumerate((x, y))]
    return gap[0] * gap[0] + gap[1] * gap[1], far[0] * far[0] + far[1] * far[1]


def nearest_places(asks: DataFrame, places: DataFrame, *, x: str = "x", y: str = "y", held: int = 16) -> DataFrame:
    """For each ``ask_id`` the ``place_id`` (all of them, on a tie) at the least
    planar distance.

    ``asks`` holds distinct ``ask_id, x, y``; ``places`` distinct
    ``place_id, x, y``. Places lie in cells, so fine that none holds more than ``held``
    of them (down to ``DEEPEST`` halvings of the extent), and cells in cells of twice the
    side. An ask looks at the ring of cells around it, on coarser levels while all are
    empty. The nearest box it meets bounds the distance; what the bound reaches on that
    level is then refined level by level, and whatever cannot be nearer is dropped.
    """
    nothing = asks.filter(F.lit(False)).select(
        "ask_id", F.lit(None).cast("bigint").alias("place_id"), F.lit(None).cast("double").alias("distance")
    )
    places = places.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    edge = places.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if edge[0] is None:
        return nothing
    # a little wider than the places, so that the last one is inside the last cell
    size = max(edge[1] - edge[0], edge[3] - edge[2], 1e-9) * (1 + 1e-9)
    share = lambda c, low: (F.col(c) - low) / size
    spot = lambda level: [F.floor(share(c, low) * F.pow(F.lit(2.0), level)).cast("bigint") for c, low in ((x, edge[0]), (y, edge[2]))]
    finest = _finest(places, spot, held)

    points = stage(places.select("place_id", x, y, *[c.alias(n) for c, n in zip(spot(F.lit(finest)), ("cx", "cy"))]))
    box = [F.array(*[pick(c) for c in (x, y)]).alias(n) for pick, n in ((F.min, "lo"), (F.max, "hi"))]
    levels = F.explode(F.sequence(F.lit(0), F.lit(finest))).alias("level")
    up = lambda c: F.expr(f"shiftright({c}, {finest} - level)").alias(c)
    cells = points.groupBy("cx", "cy").agg(*box).select("cx", "cy", "lo", "hi", levels)
    cells = cells.select("level", up("cx"), up("cy"), "lo", "hi").groupBy("level", "cx", "cy").agg(
        *[F.array(*[pick(F.col(n)[i]) for i in range(2)]).alias(n) for pick, n in ((F.min, "lo"), (F.max, "hi"))]
    )
    cells = stage(cells)

    bounds = _bounds(asks.select("ask_id", x, y), cells, spot, finest, x, y)
    # no finer level than a third of the bound, so that few cells are within it
    fit = F.floor(F.log2(F.lit(3 * size) / F.sqrt("bound")))
    level = F.greatest(F.when(F.col("bound") > 0, F.least("level", fit)).otherwise(F.col("level")), F.lit(0)).cast("int")
    frontier = bounds.withColumn("level", level)
    for name, c, low in (("cx", x, edge[0]), ("cy", y, edge[2])):
        unit = F.pow(F.lit(2.0), F.col("level"))
        place, reach = share(c, low) * unit, F.sqrt("bound") / size * unit
        first = F.greatest(F.floor(place - reach - 1e-6), F.lit(0)).cast("bigint")
        last = F.least(F.floor(place + reach + 1e-6), unit - 1).cast("bigint")
        frontier = frontier.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
        frontier = frontier.withColumn(name, F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    at = ["level", "cx", "cy"]
    while True:
        least, most = _squared(F.col("lo"), F.col("hi"), x, y)
        frontier = frontier.join(cells, at).withColumns({"_least": least, "_most": most}).filter("_least <= bound")
        nearer = F.min("_most").over(W.partitionBy("ask_id"))
        frontier = frontier.withColumn("bound", F.least("bound", nearer)).filter("_least <= bound")
        frontier = stage(frontier.select("ask_id", x, y, "bound", *at))
        if frontier.agg(F.min("level")).first()[0] in (None, finest):
            break
        # rows on the finest level wait for the others
        inner = F.col("level") < finest
        step = F.explode(F.when(inner, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        for name in ("cx", "cy"):
            frontier = frontier.withColumn("_step", step).withColumn(name, F.when(inner, F.col(name) * 2 + F.col("_step")).otherwise(F.col(name)))
        frontier = frontier.withColumn("level", F.when(inner, F.col("level") + 1).otherwise(F.col("level"))).drop("_step")

    found = points.withColumnsRenamed({x: "_px", y: "_py"})
    near = frontier.join(found, ["cx", "cy"])
    dx, dy = F.abs(F.col(x) - F.col("_px")), F.abs(F.col(y) - F.col("_py"))
    near = near.withColumn("_d", dx * dx + dy * dy).filter("_d <= bound")
    near = near.withColumn("_best", F.min("_d").over(W.partitionBy("ask_id"))).filter("_d = _best")
    return near.select("ask_id", "place_id", F.sqrt("_d").alias("distance"))


def _finest(places: DataFrame, spot, held: int) -> int:
    """The coarsest level on which no cell holds more than ``held`` places."""
    each = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("_level"))
    at = spot(F.col("_level"))
    full = each.groupBy("_level", *[c.alias(n) for c, n in zip(at, ("_cx", "_cy"))]).agg(F.count("*").alias("_n"))
    worst = full.groupBy("_level").agg(F.max("_n").alias("_n")).filter(F.col("_n") > held)
    last = worst.agg(F.max("_level")).first()[0]
    return 0 if last is None else min(last + 1, DEEPEST)


def _bounds(asks: DataFrame, cells: DataFrame, spot, finest: int, x: str, y: str) -> DataFrame:
    """``bound``, a squared distance within which each ask has a place, and the ``level``
    of the ring that showed it."""
    inside = lambda c, top: F.least(F.greatest(c, F.lit(0)), top).cast("bigint")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left, told, top = asks.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), None, finest
    while True:
        low = max(0, top - RINGS + 1)
        probe = left.select("*", F.explode(F.sequence(F.lit(low), F.lit(top))).alias("level"))
        last = F.pow(F.lit(2.0), F.col("level")) - 1
        probe = probe.select("*", *[inside(c, last).alias(n) for c, n in zip(spot(F.col("level")), ("_x", "_y"))], F.explode(around).alias("_o"))
        probe = probe.withColumns({"cx": F.col("_x") + F.col("_o.i"), "cy": F.col("_y") + F.col("_o.j")})
        _, most = _squared(F.col("lo"), F.col("hi"), x, y)
        met = probe.join(cells, ["level", "cx", "cy"]).groupBy("ask_id", x, y, "level").agg(F.min(most).alias("bound"))
        best = F.max_by(F.struct("bound", "level"), F.col("level")).alias("_b")
        met = met.groupBy("ask_id", x, y).agg(best).select("ask_id", x, y, "_b.*")
        if low == 0:
            return met if told is None else told.unionByName(met)
        met = stage(met)
        told = met if told is None else told.unionByName(met)
        left = stage(left.join(met.select("ask_id"), "ask_id", "left_anti"))
        if left.isEmpty():
            return told
        top = low - 1
