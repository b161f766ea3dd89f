"""Scatter points."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chartmill.columns import chart_value, named, require_numeric


def scatter_points(
    df: DataFrame, x: str, y: str, group: str | None = None, max_points: int | None = None
) -> DataFrame:
    """Raw points x, y[, series] as doubles.

    A row without x has no place on the chart and is left out; a missing y is 0.
    """
    require_numeric(df, x)
    require_numeric(df, y)
    columns = [named(x).cast("double").alias("x"), chart_value(named(y)).alias("y")]
    if group is not None:
        columns.append(named(group).alias("series"))
    points = df.filter(named(x).isNotNull()).select(*columns)
    if max_points is None:
        return points
    return points.orderBy(*points.columns).limit(max_points)
