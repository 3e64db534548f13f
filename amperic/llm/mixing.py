"""Mixing sources to target weights by proportionate-fair scheduling, in DataFrame
operations only.

Each source is cut into blocks of about equal size. With weight ``w``, its block
``j`` (from 1) may not come before slot ``floor((j - 1) / w)`` and must come before
slot ``ceil(j / w)``. Earliest deadline first then fills every slot, and after any
number of slots each source has less than one block more or less than its weight.

Weights are shares of a period of slots, so the schedule repeats. One period is
worked out from the shares alone, and a block's slot follows from its number.

Rules for odd input: a NULL source is the source ``""``; a NULL text has length
0. No row is dropped: a source that has run out leaves its later slots empty.
Rows are ordered within a source by a hash of ``doc_id``, ties by the id, length
and hash of the text. Other columns pass through. An empty table gives an empty
table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.llm.common import fresh, whole_text


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Slots of a period per source, at least one each: the largest remainders
    are rounded up, ties by name."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of at least as many slots, not {period}")
    total = math.fsum(weights.values())
    spare = period - len(weights)
    exact = {s: (spare * w / total if total else spare / len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(e) for s, e in exact.items()}
    left = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:left]:
        out[s] += 1
    return out


def schedule(parts: Mapping[str, int]) -> list[str]:
    """The source of each slot of a period, by earliest deadline among the
    released; ties go to the larger share, then by name."""
    period = sum(parts.values())
    arrivals = sorted((j * period // n, -(-(j + 1) * period // n), -n, s) for s, n in parts.items() for j in range(n))
    ready: list[tuple[int, int, str]] = []
    out, k = [], 0
    for slot in range(period):
        while k < len(arrivals) and arrivals[k][0] <= slot:
            heapq.heappush(ready, arrivals[k][1:])
            k += 1
        out.append(heapq.heappop(ready)[2])
    return out


def source_weights(docs: DataFrame, *, exponent: float, most: int) -> dict[str, float]:
    """Characters per source to a power: 1 keeps the sizes, 0 makes all equal."""
    sizes = (
        docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
        .agg(F.sum(F.length(whole_text())).alias("n")).limit(most + 1).collect()
    )
    return {r["source"]: float(r["n"]) ** exponent for r in sizes}


def mix_sources(
    docs: DataFrame,
    *,
    weights: Mapping[str, float] | None = None,
    exponent: float = 0.5,
    period: int = 1000,
    block_chars: int = 16384,
    slice_digits: int = 2,
) -> DataFrame:
    """All columns of ``docs``, and ``block`` (from 0), ``slot``, ``release``,
    ``deadline`` (slots) and ``begin`` (characters of the source before the row).
    Sorting by ``slot`` and ``begin`` gives the mixed order.

    Without ``weights`` they follow from the sizes of the sources. Every source
    needs a weight, and there are at most ``period`` sources. Rows of a source
    are numbered in slices by hash, and the slices' totals are added up after, so
    a large source is not one task's work.
    """
    if weights is None:
        weights = source_weights(docs, exponent=exponent, most=period)
    parts = shares(weights, period)
    spark = docs.sparkSession
    at: dict[str, int] = {}
    plan = []
    for slot, s in enumerate(schedule(parts) if parts else []):
        plan.append((s, at.get(s, 0), slot, parts[s]))
        at[s] = at.get(s, 0) + 1
    source, order, size, tag, part, index, share, at_slot, total, offset, begin, block = fresh(
        docs, "source", "order", "size", "tag", "part", "index", "share", "slot", "total", "offset", "begin", "block"
    )
    table = spark.createDataFrame(plan, f"{source} string, {index} long, {at_slot} long, {share} long")

    text = whole_text()
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.withColumns({source: name, order: key, size: F.length(text).cast("long"), tag: F.xxhash64(text)})
    rows = rows.withColumn(part, F.substring(order, 1, slice_digits))
    totals = docs.select(name.alias(source), F.substring(key, 1, slice_digits).alias(part), F.length(text).cast("long").alias(size))
    totals = totals.groupBy(source, part).agg(F.sum(size).alias(total))
    # one row per slice of a source: bounded by the number of slices
    before = W.partitionBy(source).orderBy(part)
    totals = totals.select(source, part, (F.sum(total).over(before) - F.col(total)).alias(offset))
    inside = W.partitionBy(source, part).orderBy(order, "doc_id", size, tag).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn(begin, F.sum(size).over(inside) - F.col(size)).join(totals, [source, part])
    rows = rows.withColumn(begin, F.col(begin) + F.col(offset))
    rows = rows.withColumn(block, F.floor(F.col(begin) / F.lit(block_chars)))
    # the plan has ``period`` rows
    rows = rows.join(F.broadcast(table.select(source, share).distinct()), source)
    rows = rows.withColumn(index, F.pmod(block, share)).join(F.broadcast(table.drop(share)), [source, index])
    cycle = F.floor(F.col(block) / F.col(share)) * F.lit(period)
    return rows.select(
        *[F.col(c) for c in docs.columns],
        F.col(block).alias("block"),
        (cycle + F.col(at_slot)).alias("slot"),
        F.expr(f"{block} * {period} div {share}").alias("release"),
        F.ceil((F.col(block) * F.lit(period) + F.lit(period)) / F.col(share)).alias("deadline"),
        F.col(begin).alias("begin"),
    )
