"""Connected components by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amperic.operators.kernels import least_joined
from amperic.session import stage

# Links that one task may hold: two numbers each.
FEW = 1_000_000


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction step: every node hands its neighbours (all larger ones,
    or itself and the smaller ones) to the least node it knows of."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hub"))
        moved = both.join(hubs, "a").filter("b > a").select(F.col("b").alias("a"), F.col("hub").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        hubs = down.groupBy("a").agg(F.min("b").alias("hub"))
        moved = (
            down.join(hubs, "a")
            .filter("b <> hub")
            .select(F.col("b").alias("a"), F.col("hub").alias("b"))
            .unionByName(hubs.select("a", F.col("hub").alias("b")))
        )
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root``: the least node of each component, for nodes with an edge.

    Each round is one shuffle by node for either step; the number of rounds grows
    with the logarithm of the graph, not with its diameter. Rounds are staged, so
    the plan stays short.
    """
    state = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        state = stage(_stars(_stars(state, True), False))
        now = state.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def linked(edges: DataFrame, *, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """The same as :func:`components`. Up to ``few`` distinct links are joined in one task,
    which takes one shuffle in place of several a round."""
    state = stage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct())
    if state.count() > few:
        return components(state)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, place = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
        place = place.reshape(-1, 2)
        return pd.DataFrame({"node": nodes, "root": nodes[least_joined(len(nodes), place[:, 0], place[:, 1])]})

    return state.groupBy().applyInPandas(solve, "node bigint, root bigint")
