"""Ordered scans that never put one key, or the whole table, into one task.

A window over ``partitionBy(key)`` sends a hot key to one task, and a window
without keys sends everything there. The operators here cut the order into time
slices, scan each slice on its own, and carry the little that crosses a slice
border (one summary row per key and slice) in a second, small scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.functions.clock import DAY, slot


def _over_slices(keys: Sequence[str], by: Column | str):
    """Window over slice summaries: one row per slice, hence bounded by the time span."""
    return W.partitionBy(*keys).orderBy(by)


def with_slice(df: DataFrame, seconds: Column, width: int = DAY, name: str = "_slice") -> DataFrame:
    return df.withColumn(name, slot(seconds, width))


def even_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Adds ``_slice``, which cuts the rows by keys and order into parts of about
    equal size, whatever the keys. Equal rows share a slice. The bounds are
    sampled, so ``df`` should be staged, and so should the result if it is read
    more than once."""
    by = [*keys, *order]
    spread = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    return spread.withColumn("_slice", F.spark_partition_id().cast("bigint"))


def neighbours(
    df: DataFrame,
    order: Sequence[str],
    *,
    keys: Sequence[str] = (),
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    slice_col: str = "_slice",
) -> DataFrame:
    """Lag and lead by one row per key, across slice borders.

    ``previous``/``following`` map a new column name to the column it is read
    from. ``slice_col`` must not decrease along ``order``.
    """
    previous, following = dict(previous or {}), dict(following or {})
    group = [*keys, slice_col]
    w = W.partitionBy(*group).orderBy(*order)
    at = F.struct(*order)
    # the marker field keeps the struct non-NULL when every value in it is NULL
    first = F.struct(F.lit(1).alias("__is"), *[F.col(c).alias(n) for n, c in following.items()])
    last = F.struct(F.lit(1).alias("__is"), *[F.col(c).alias(n) for n, c in previous.items()])

    ends = df.groupBy(*group).agg(F.min_by(first, at).alias("__first"), F.max_by(last, at).alias("__last"))
    by_slice = _over_slices(keys, slice_col)
    ends = ends.select(
        *group,
        F.lag("__last").over(by_slice).alias("__before"),
        F.lead("__first").over(by_slice).alias("__after"),
    )
    rows = df
    if previous:
        rows = rows.withColumn("__prev", F.lag(last).over(w))
    if following:
        rows = rows.withColumn("__next", F.lead(first).over(w))
    rows = rows.join(ends, group)
    out = [F.col(c) for c in df.columns]
    out += [F.coalesce("__prev", "__before")[n].alias(n) for n in previous]
    out += [F.coalesce("__next", "__after")[n].alias(n) for n in following]
    return rows.select(*out)


def running(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    how: str,
    out: str,
    *,
    keys: Sequence[str] = (),
    backward: bool = False,
    exclusive: bool = False,
    slice_col: str = "_slice",
) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` per key, across slice borders.

    ``exclusive`` leaves out the row itself.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    group = [*keys, slice_col]
    turn = (lambda c: F.col(c).desc()) if backward else F.col
    frame = (W.unboundedPreceding, -1 if exclusive else 0)
    w = W.partitionBy(*group).orderBy(*[turn(c) for c in order]).rowsBetween(*frame)
    totals = df.groupBy(*group).agg(fold(value).alias("__total"))
    past = _over_slices(keys, turn(slice_col)).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, fold("__total").over(past).alias("__carried"))
    rows = df.withColumn("__inside", fold(value).over(w)).join(totals, group)
    if how == "sum":
        merged = F.coalesce("__inside", F.lit(0)) + F.coalesce("__carried", F.lit(0))
    else:
        merged = {"max": F.greatest, "min": F.least}[how]("__inside", "__carried")
    return rows.select(*df.columns, merged.alias(out))


def islands(
    points: DataFrame,
    t: str,
    max_gap: float | int,
    *,
    keys: Sequence[str] = (),
    closed: bool = True,
    width: int = DAY,
) -> DataFrame:
    """Runs of times whose neighbours are at most (``closed``) or less than
    ``max_gap`` seconds apart, per key.

    Returns the distinct ``(keys, t, island)`` where ``island`` is the first
    second of the run. Copies of a second collapse before anything is sorted, so
    a slice never holds more rows than it has seconds.
    """
    group = [*keys, "_slice"]
    near = (lambda gap: gap <= F.lit(max_gap)) if closed else (lambda gap: gap < F.lit(max_gap))
    times = with_slice(points.select(*keys, t).distinct(), F.col(t), width).repartition(*group)

    w = W.partitionBy(*group).orderBy(t)
    begins = ~F.coalesce(near(F.col(t) - F.lag(t).over(w)), F.lit(False))
    times = times.withColumn("__begin", F.when(begins, F.col(t)))
    times = times.withColumn("__run", F.max("__begin").over(w.rowsBetween(W.unboundedPreceding, 0)))

    ends = times.groupBy(*group).agg(
        F.min(t).alias("__first"), F.max(t).alias("__last"), F.max("__run").alias("__last_run")
    )
    by_slice = _over_slices(keys, "_slice")
    ends = ends.withColumn(
        "__goes_on", F.coalesce(near(F.col("__first") - F.lag("__last").over(by_slice)), F.lit(False))
    )
    # where the last run of a slice began, unless it entered from an earlier slice
    ends = ends.withColumn(
        "__anchor",
        F.when(F.col("__last_run") != F.col("__first"), F.col("__last_run")).when(
            ~F.col("__goes_on"), F.col("__first")
        ),
    )
    entered = F.max("__anchor").over(by_slice.rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(
        *group, "__first", F.when(F.col("__goes_on"), entered).otherwise(F.col("__first")).alias("__first_id")
    )
    return times.join(ends, group).select(
        *keys,
        t,
        F.when(F.col("__run") == F.col("__first"), F.col("__first_id")).otherwise(F.col("__run")).alias("island"),
    )


def count_within(counts: DataFrame, t: str, n: str, eps: int, out: str, *, keys: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Per distinct second, the sum of ``n`` over ``[t - eps, t + eps]``.

    Seconds within ``eps`` of a slice border are copied into the next slice, so
    each slice answers for its own seconds alone.
    """
    eps = int(eps)
    width = max(width, eps + 1)
    home = slot(F.col(t), width)
    places = F.array_compact(
        F.array(
            home,
            F.when(F.col(t) - eps < home * width, home - 1),
            F.when(F.col(t) + eps >= (home + 1) * width, home + 1),
        )
    )
    spread = counts.withColumn("__home", home).withColumn("_slice", F.explode(places))
    w = W.partitionBy(*keys, "_slice").orderBy(t).rangeBetween(-eps, eps)
    return (
        spread.withColumn(out, F.sum(n).over(w)).filter("_slice = __home").select(*keys, t, n, out)
    )


def nearest(
    queries: DataFrame,
    marks: DataFrame,
    t: str,
    at: str,
    label: str,
    *,
    keys: Sequence[str] = (),
    width: int = DAY,
    out: str = "nearest_label",
) -> DataFrame:
    """Label of the mark closest in time to each query time, per key.

    Equal distances take the lowest label. The result has the distinct
    ``(keys, t)`` of ``queries`` with ``out``. Two ordered scans (last mark
    before, first mark after) stand in for comparing every query with every mark.
    """
    spots = marks.groupBy(*keys, F.col(at).cast("double").alias("_t")).agg(F.min(label).alias("_label"))
    spots = spots.withColumn("_mark", F.struct(F.col("_t").alias("at"), F.col("_label").alias("label")))
    asks = queries.select(*keys, F.col(t).cast("double").alias("_t")).distinct()
    line = (
        spots.select(*keys, "_t", "_mark", F.lit(0).alias("_ask"))
        .unionByName(asks.select(*keys, "_t", F.lit(None).cast(spots.schema["_mark"].dataType).alias("_mark"), F.lit(1).alias("_ask")))
        # one row per time: a time may be both a mark and a query
        .groupBy(*keys, "_t")
        .agg(F.max("_mark").alias("_mark"), F.max("_ask").alias("_ask"))
    )
    line = with_slice(line, F.col("_t"), width)
    line = running(line, ["_t"], "_mark", "max", "_before", keys=keys)
    line = running(line, ["_t"], "_mark", "min", "_after", keys=keys, backward=True)
    gap_before, gap_after = F.col("_t") - F.col("_before.at"), F.col("_after.at") - F.col("_t")
    pick = (
        F.when(F.col("_after").isNull() | (gap_before < gap_after), F.col("_before.label"))
        .when(F.col("_before").isNull() | (gap_after < gap_before), F.col("_after.label"))
        .otherwise(F.least("_before.label", "_after.label"))
    )
    back = queries.schema[t].dataType
    return line.filter("_ask = 1").select(
        *keys, F.col("_t").cast(back).alias(t), pick.alias(out), F.least(gap_before, gap_after).alias("nearest_gap")
    )
