"""Distance between sensors along the supply grid.

0 same sensor, 1 same transformer, 2 same feeder, 3 same substation, else 4,
valid while both topology rows are. The full edge list grows with the square of
the sensors, so it is never written out: pairs are looked up on demand, and the
counts over all pairs come from group sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amperic.functions.clock import epoch
from amperic.operators.ordered import even_slices, running
from amperic.session import stage

OPEN_END = "2300-01-01 00:00:00"
OPEN_START = "1970-01-01 00:00:00"
FARTHEST = 4


def prepared(topology: DataFrame) -> DataFrame:
    """Topology rows with a substation (leading capitals of the feeder, maybe
    none) and closed-over open interval ends."""
    return topology.select(
        "core_id",
        F.coalesce("start_time", F.lit(OPEN_START).cast("timestamp")).alias("start_time"),
        F.coalesce("end_time", F.lit(OPEN_END).cast("timestamp")).alias("end_time"),
        "transformer",
        "feeder",
        F.regexp_extract("feeder", "^[A-Z]*", 0).alias("substation"),
    )


def grid_distance(a: str, b: str) -> Column:
    """Distance between two topology structs; the closest shared level wins."""
    def same(level):
        return F.col(f"{a}.{level}") == F.col(f"{b}.{level}")

    return (
        F.when(same("core_id"), 0)
        .when(same("transformer"), 1)
        .when(same("feeder"), 2)
        .when(same("substation"), 3)
        .otherwise(FARTHEST)
    )


def pair_distances(pairs: DataFrame, topology: DataFrame, *, one: str = "core_1", two: str = "core_2", at: str | None = None) -> DataFrame:
    """Grid distance of given sensor pairs, with the common validity.

    Two key joins per pair. Validity intervals that only touch count as common;
    with ``at`` (epoch seconds) they must also hold that time. Of several common
    intervals the earliest is taken; pairs without one have NULL.
    """
    grid = prepared(topology)
    levels = F.struct("core_id", "transformer", "feeder", "substation", "start_time", "end_time")
    side = grid.select("core_id", levels.alias("_g"))
    want = [c for c in dict.fromkeys([one, two, at]) if c]
    asked = pairs.select(*want).distinct()
    found = (
        asked.join(side.select(F.col("core_id").alias(one), F.col("_g").alias("_a")), one)
        .join(side.select(F.col("core_id").alias(two), F.col("_g").alias("_b")), two)
        .withColumn("common_start", F.greatest("_a.start_time", "_b.start_time"))
        .withColumn("common_end", F.least("_a.end_time", "_b.end_time"))
        .filter("common_end >= common_start")
    )
    if at:
        found = found.filter(F.timestamp_seconds(at).between(F.col("common_start"), F.col("common_end")))
    first = found.groupBy(*want).agg(
        F.min(F.struct("common_start", "common_end", grid_distance("_a", "_b").alias("d"))).alias("_f")
    )
    first = first.select(
        *want,
        F.col("_f.common_start").alias("common_start"),
        F.col("_f.common_end").alias("common_end"),
        F.col("_f.d").alias("grid_distance"),
    )
    return pairs.join(first, want, "left")


# Classes of rows that one task multiplies by level sets: some hundred megabytes.
TASK_CLASSES = 50_000


def distance_profile(topology: DataFrame, *, task_classes: int = TASK_CLASSES) -> DataFrame:
    """For every topology row, the number of rows at each distance 0..4 whose
    validity overlaps its own; the row itself is at distance 0.

    A level's partners are counted, not listed. Rows overlapping ``[s, e]`` in a
    group are all its rows less those that end before ``s`` or start after
    ``e``, which are running counts over the group's distinct times. A row at
    distance ``k`` shares level ``k`` but none before it, so inclusion and
    exclusion over the shared levels gives each count. Rows alike in all that
    counts are one class with a weight: without the sensor for what any two rows may
    share, with it for what is left out again because the sensor is the same.
    """
    grid = prepared(topology).withColumn("_s", epoch(F.col("start_time"))).withColumn("_e", epoch(F.col("end_time")))
    kind = ["transformer", "feeder", "substation", "_s", "_e"]
    span = ["core_id", "start_time", "end_time"]
    weight = F.count("*").alias("_n")
    rows = stage(grid.groupBy(*span, *kind).agg(weight))
    kinds = stage(rows.groupBy(*kind).agg(F.sum("_n").alias("_n")))
    any_two = _apart(kinds, [], kind, task_classes)
    one_core = _apart(rows, ["core_id"], [*span, *kind], task_classes)
    any_two = any_two.select(*[F.col(c).alias(f"_{c}") for c in kind], F.col("_apart").alias("_all"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kind])
    met = one_core.join(any_two, same)
    # by how many of the levels are not shared: none asked, the sensor, the transformer, ...
    apart = [F.col("_all")[0], *[F.col("_all")[k] - F.col("_apart")[k] for k in range(FARTHEST)]]
    counts = [(apart[k] - apart[k + 1]).alias(f"distance_{k}") for k in range(FARTHEST)]
    counts.append(apart[FARTHEST].alias(f"distance_{FARTHEST}"))
    met = met.select(*span, "_n", *counts)
    return met.groupBy(*span).agg(*[F.sum(F.col(c) * F.col("_n")).alias(c) for c in met.columns[len(span) + 1 :]])


def _apart(classes: DataFrame, keys: Sequence[str], whole: Sequence[str], task_classes: int) -> DataFrame:
    """``whole``, ``_n`` and ``_apart``: per class, the rows overlapping it that agree in ``keys``
    and in none of the first 0..3 levels above the sensor. ``classes`` are staged and distinct.

    Every class is multiplied by sets of levels and by its ends, so tasks are cut by the
    number of classes, and what comes of it is never broadcast: the planner takes it to be
    as small as the classes.
    """
    levels = ["transformer", "feeder", "substation"]
    sets = [combo for k in range(len(levels) + 1) for combo in combinations(levels, k)]
    tags = F.array(
        *[
            F.struct(
                F.lit(i).alias("set"),
                F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in [*keys, *combo]], F.lit(i).alias("n"))).alias("val"),
            )
            for i, combo in enumerate(sets)
        ]
    )
    spread = classes.repartition(max(1, -(-classes.count() // task_classes)), *whole)
    tagged = spread.withColumn("_tag", F.explode(tags)).select(*whole, "_n", "_tag.set", F.col("_tag.val").alias("_g"))

    none = F.lit(0).cast("bigint")
    edge = F.explode(
        F.array(
            F.struct(F.col("_s").alias("v"), F.col("_n").alias("starts"), none.alias("ends")),
            F.struct(F.col("_e").alias("v"), none.alias("starts"), F.col("_n").alias("ends")),
        )
    )
    line = tagged.select("_g", edge.alias("x")).groupBy("_g", F.col("x.v").alias("_v")).agg(
        F.sum("x.starts").alias("_starts"), F.sum("x.ends").alias("_ends")
    )
    # slices of even size, so the group of all rows is no single task's
    line = stage(even_slices(stage(line), ["_g"], ["_v"]))
    line = running(line, ["_v"], "_ends", "sum", "_ended", keys=["_g"], exclusive=True)
    line = stage(running(line, ["_v"], "_starts", "sum", "_later", keys=["_g"], backward=True, exclusive=True))

    sizes = line.groupBy("_g").agg(F.sum("_starts").alias("_size"))
    begun = line.select("_g", F.col("_v").alias("_s"), "_ended")
    over = line.select("_g", F.col("_v").alias("_e"), "_later")
    met = tagged.hint("merge").join(sizes, "_g").hint("merge").join(begun, ["_g", "_s"]).hint("merge").join(over, ["_g", "_e"])
    shared = F.col("_size") - F.col("_ended") - F.col("_later")
    # |none of the first k levels shared| by inclusion and exclusion
    apart = []
    for k in range(len(levels) + 1):
        sign = none
        for i, combo in enumerate(sets):
            if set(combo) <= set(levels[:k]):
                sign = F.when(F.col("set") == i, (-1) ** len(combo)).otherwise(sign)
        apart.append(F.sum(shared * sign))
    return met.groupBy(*whole, "_n").agg(F.array(*apart).alias("_apart"))
