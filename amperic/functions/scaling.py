"""Feature scaling and small numeric helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, cols: Sequence[str], weights: Mapping[str, float] | None = None, prefix: str = "z_") -> DataFrame:
    """Add ``(x - mean) / population std`` per column, times its weight.

    A constant column becomes 0. All moments arrive as one one-row scalar
    subquery, so no row is sent to the driver and the table is read once for them.
    """
    weights = weights or {}
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"mean{i}") for i, c in enumerate(cols)],
            *[F.stddev_pop(c).alias(f"std{i}") for i, c in enumerate(cols)],
        )
    ).scalar()

    def scaled(i, name):
        mean, std = moments[f"mean{i}"], moments[f"std{i}"]
        z = F.when(std == 0, F.lit(0.0)).otherwise((F.col(name) - mean) / std)
        return z * F.lit(float(weights.get(name, 1.0)))

    return df.withColumns({prefix + name: scaled(i, name) for i, name in enumerate(cols)})


def scaled_eps(df: DataFrame, col: str, eps: float) -> float:
    """A radius given in standard deviations, in the units of ``col``."""
    std = df.agg(F.stddev_pop(col)).first()[0]
    return float(eps) * float(std or 0.0)


def percent(part: Column, rest: Column) -> Column:
    """``part`` in percent of ``part + rest``; NULL when both are zero."""
    return F.try_divide(part, part + rest) * 100
