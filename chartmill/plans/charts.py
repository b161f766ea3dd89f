"""From one chart of a spec to its dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.functions.derive import documented_concat
from chartmill.operators import funnel as funnels
from chartmill.operators.heatmap import heatmap
from chartmill.operators.ordering import sort_limit
from chartmill.operators.retention import retention
from chartmill.operators.scatter import scatter_points
from chartmill.operators.series import (
    area_series,
    bar_series,
    capped,
    chart_cells,
    line_series,
    series_keys,
    stacked_bar,
)
from chartmill.plans.spec import Chart, check_chart
from chartmill.plans.stages import prepare, sort_keys

DEFAULT_AGG = "sum"
DEFAULT_BINS = 10
GROUPED_CHARTS = ("line", "area", "bar", "bar-stacked", "scatter")

# Spec fields that name source columns, and what those columns are called in the dataset.
DATASET_NAMES = {
    "x": "x",
    "y": "y",
    "z": "z",
    "group_by": "series",
    "values": "value",
    "cohort_date": "cohort",
    "period_number": "period",
    "users": "users",
}


def _step_column(df: DataFrame, chart: Chart) -> str:
    given = chart.get("step_col") or chart.get("x")
    if given:
        return given
    texts = [field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)]
    if len(texts) != 1:
        raise ValueError("name the column that holds the steps in 'step_col'")
    return texts[0]


def prepared(df: DataFrame, chart: Chart) -> DataFrame:
    """Filters, then derived columns; expressions of a spec may use its documented concat."""
    derived = {
        name: documented_concat(df.sparkSession, text) for name, text in (chart.get("derive") or {}).items()
    }
    return prepare(df, chart.get("filter"), derived)


def _dataset(df: DataFrame, chart: Chart, large: bool | None) -> DataFrame:
    kind = chart["type"]
    x, y, group = chart.get("x"), chart.get("y"), chart.get("group_by")
    agg = chart.get("agg") or DEFAULT_AGG
    normalize = bool(chart.get("normalize"))
    cap = chart.get("max_points")
    if kind == "line":
        return line_series(df, x, y, group, agg, cap, large)
    if kind == "area":
        stacked = chart.get("stacked")
        return area_series(df, x, y, group, agg, True if stacked is None else stacked, normalize, cap, large)
    if kind == "bar":
        return bar_series(df, x, y, group, agg, bool(chart.get("stacked")), normalize, cap, large)
    if kind == "bar-stacked":
        return stacked_bar(df, y, group, x, agg, cap, large)
    if kind == "heatmap":
        return heatmap(df, x, y, chart["z"], chart.get("bins") or DEFAULT_BINS, agg, large)
    if kind == "scatter":
        if chart.get("agg") is None:
            return scatter_points(df, x, y, group, cap)
        keys = {"x": x} if group is None else {"x": x, "series": group}
        return scatter_points(chart_cells(df, keys, y, agg, large), "x", "y", "series" if group else None, cap)
    if kind == "funnel":
        build = funnels.funnel_conversion if chart.get("conversion_rates") else funnels.funnel
        return build(df, chart["steps"], _step_column(df, chart), chart["values"], chart.get("step_order"))
    percentage = chart.get("percentage")
    return retention(
        df,
        chart["cohort_date"],
        chart["period_number"],
        chart["users"],
        True if percentage is None else percentage,
    )


def build_chart(df: DataFrame, chart: Chart, large: bool | None = None) -> DataFrame:
    """Filter and derive, build the chart's dataset, then sort and limit that.

    Sort entries may use the source column names or the dataset's own. ``large`` chooses the plan of
    medians and stacks in place of the measured size; with False nothing runs here.
    """
    check_chart(chart)
    dataset = _dataset(prepared(df, chart), chart, large)
    return finished(dataset, chart)


def from_cells(cells: DataFrame, chart: Chart) -> DataFrame:
    """The dataset of a plain chart whose cells (x, [series,] y) are at hand."""
    return finished(capped(cells, [name for name in cells.columns if name != "y"], chart.get("max_points")), chart)


def finished(dataset: DataFrame, chart: Chart) -> DataFrame:
    """Sorted and limited as the chart says."""
    renamed = {chart[field]: name for field, name in DATASET_NAMES.items() if chart.get(field)}
    return sort_limit(dataset, sort_keys(chart.get("sort"), renamed), chart.get("limit"))


def legend(df: DataFrame, chart: Chart) -> DataFrame:
    """series: what the chart's legend names.

    The distinct series of a grouped chart, the steps of a funnel in their
    order, else one label for the only value shown.
    """
    check_chart(chart)
    kind = chart["type"]
    if chart.get("group_by") and kind in GROUPED_CHARTS:
        keys = series_keys(prepared(df, chart), chart["group_by"])
        return keys.select(F.col("series").cast("string").alias("series"))
    if kind == "funnel":
        return build_chart(df, {**chart, "conversion_rates": False}).select(F.col("step").alias("series"))
    if kind == "scatter":
        label = f"{chart['y']} vs {chart['x']}"
    elif kind == "retention":
        label = "retention_pct" if chart.get("percentage", True) else chart["users"]
    else:
        label = chart["z"] if kind == "heatmap" else chart["y"]
    return df.sparkSession.range(1).select(F.lit(label).alias("series"))
