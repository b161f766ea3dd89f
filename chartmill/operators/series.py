"""Line, area and bar datasets: plain, grouped, stacked and normalised.

``large`` chooses the plan of medians and stacks in place of the measured size: False for
windows and built-in medians, which run nothing while they are planned; True for ranges
and rank selection, which run jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.columns import chart_value, join_on, named
from chartmill.operators import running
from chartmill.operators.aggregates import aggregate, check_aggregate
from chartmill.operators.grid import axis, dense_grid
from chartmill.operators.running import ranged_total, running_total, windowed_total
from chartmill.sizing import is_small, settled


def chart_cells(df: DataFrame, keys: dict[str, str], y: str, agg: str, large: bool | None = None) -> DataFrame:
    """One row per key combination under the names in ``keys``, with a double ``y``.

    A group without any value gets 0.
    """
    check_aggregate(agg)
    picked = df.select(*[named(column).alias(name) for name, column in keys.items()], named(y).alias("y"))
    cells = aggregate(picked, list(keys), "y", agg, large)
    return cells.select(*keys, chart_value(F.col("y")).alias("y"))


def capped(df: DataFrame, order: list[str], max_points: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if max_points is None else ordered.limit(max_points)


def _any_height(cells: DataFrame) -> Column:
    """True when the stack of some x is higher than 0, as a scalar subquery."""
    return axis(cells, "x", "y").agg(F.max("total")).scalar() > 0


def _with_share(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Add share_pct of the total at x; 0 where that total is 0.

    The totals are aggregated and joined back: AQE broadcasts them when they are
    few and splits skewed partitions when they are not.
    """
    share = F.when(F.col("total") != 0, 100 * F.col("y") / F.col("total")).otherwise(F.lit(0.0))
    return join_on(rows, axis(cells, "x", "y"), ["x"]).withColumn("share_pct", share).drop("total")


def _stacked(cells: DataFrame, normalize: bool, large: bool | None) -> DataFrame:
    """Running stacks per x over the dense grid, series in natural order.

    In the grid every x holds each series exactly once, so the number of series
    is the size of all windows. It is measured when the input is large.
    """
    total = windowed_total
    if not is_small(cells, large):
        cells = settled(cells)
        if large or axis(cells, "series", "y").count() > running.MAX_WINDOW_ROWS:
            total = ranged_total
    dense = dense_grid(cells, "x", "series", "y", by_row=total is windowed_total)
    if normalize:
        dense = _with_share(dense, cells)
    stack = total(dense, ["x"], ["series"], "share_pct" if normalize else "y")
    renamed = stack.withColumnsRenamed({"before": "y_start", "until": "y_end"})
    return renamed.filter(_any_height(cells))


def _series(
    df: DataFrame,
    x: str,
    y: str,
    group: str | None,
    agg: str,
    stacked: bool,
    normalize: bool,
    max_points: int | None,
    large: bool | None,
) -> DataFrame:
    if group is None:
        return capped(chart_cells(df, {"x": x}, y, agg, large), ["x"], max_points)
    cells = chart_cells(df, {"x": x, "series": group}, y, agg, large)
    if stacked:
        cells = _stacked(cells, normalize, large)
    elif normalize:
        cells = _with_share(cells, cells)
    return capped(cells, ["x", "series"], max_points)


def line_series(
    df: DataFrame,
    x: str,
    y: str,
    group: str | None = None,
    agg: str = "sum",
    max_points: int | None = None,
    large: bool | None = None,
) -> DataFrame:
    """x, y - or x, series, y with a group - in order of x."""
    return _series(df, x, y, group, agg, False, False, max_points, large)


def area_series(
    df: DataFrame,
    x: str,
    y: str,
    group: str | None = None,
    agg: str = "sum",
    stacked: bool = False,
    normalize: bool = False,
    max_points: int | None = None,
    large: bool | None = None,
) -> DataFrame:
    """As ``line_series``; with a group optionally stacked and/or normalised.

    ``stacked`` adds y_start and y_end on a grid where absent cells are 0.
    ``normalize`` adds share_pct, the percentage of all y at that x; stacks are
    then built from the shares.
    """
    return _series(df, x, y, group, agg, stacked, normalize, max_points, large)


def bar_series(
    df: DataFrame,
    x: str,
    y: str,
    group: str | None = None,
    agg: str = "sum",
    stacked: bool = False,
    normalize: bool = False,
    max_points: int | None = None,
    large: bool | None = None,
) -> DataFrame:
    """One bar per x, per (x, series), or one stack per x."""
    return _series(df, x, y, group, agg, stacked, normalize, max_points, large)


def stacked_bar(
    df: DataFrame, y: str, group: str, x: str | None = None, agg: str = "sum", max_points: int | None = None,
    large: bool | None = None,
) -> DataFrame:
    """x, series, y, y_start, y_end; without x a single stack over the groups.

    Empty when no stack is higher than 0.
    """
    if x is not None:
        return _series(df, x, y, group, agg, True, False, max_points, large)
    stack = running_total(chart_cells(df, {"series": group}, y, agg, large), [], ["series"], "y", large)
    # The height comes from the totals' own input, settled or not: no second scan.
    stack = stack.filter(stack.agg(F.sum("y")).scalar() > 0)
    stack = stack.select("series", "y", F.col("before").alias("y_start"), F.col("until").alias("y_end"))
    return capped(stack, ["series"], max_points)


def series_keys(df: DataFrame, group: str) -> DataFrame:
    """The distinct series of a grouped chart (its legend)."""
    return df.select(named(group).alias("series")).distinct()
