"""Axis extents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.columns import named

HEADROOM = 1.1
PADDING = 0.1


def value_extent(df: DataFrame, y: str = "y") -> DataFrame:
    """y_lo = 0 and y_hi = the largest value, at least 0, plus 10 %."""
    highest = F.greatest(F.max(named(y).cast("double")), F.lit(0.0))
    return df.agg(F.lit(0.0).alias("y_lo"), (F.coalesce(highest, F.lit(0.0)) * HEADROOM).alias("y_hi"))


def scatter_extent(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Smallest and largest x and y, each padded by 10 % of the range."""
    figures = []
    for name, column in (("x", named(x).cast("double")), ("y", named(y).cast("double"))):
        padding = (F.max(column) - F.min(column)) * PADDING
        figures.append((F.min(column) - padding).alias(f"{name}_lo"))
        figures.append((F.max(column) + padding).alias(f"{name}_hi"))
    return points.agg(*figures)
