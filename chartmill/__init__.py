"""Chart-ready datasets from event and web-analytics tables, on Spark."""

from chartmill.functions.derive import derive, register_functions
from chartmill.operators.aggregates import aggregate, aggregate_all
from chartmill.operators.distinct import dense_ids, distinct_ids, id_bitmaps, merge_bitmaps, rolling_distinct
from chartmill.operators.extent import scatter_extent, value_extent
from chartmill.operators.feeders import cohorts, funnel_counts, hour_weekday, period_series
from chartmill.operators.filters import apply_filters
from chartmill.operators.funnel import funnel, funnel_conversion
from chartmill.operators.heatmap import heatmap, heatmap_cells, with_bins, with_intensity
from chartmill.operators.joins import join_sources
from chartmill.operators.journeys import ordered_funnel, ordered_funnel_conversion, session_hours, sessions, step_reached
from chartmill.operators.ordering import sort_limit
from chartmill.operators.retention import retention, retention_table, with_retention_intensity
from chartmill.operators.scatter import scatter_points
from chartmill.operators.series import area_series, bar_series, line_series, series_keys, stacked_bar
from chartmill.operators.sketches import merge_sketches, quantile_series, quantile_sketch, quantiles, sketch_quantile
from chartmill.plans.batch import batch_status, chart_batch, long_form, row_counts, write_batch
from chartmill.plans.charts import build_chart, legend
from chartmill.plans.publish import publish_batch, read_published
from chartmill.plans.spec import check_chart, check_spec, load_spec
from chartmill.plans.stages import transform
from chartmill.session import build_session
from chartmill.sources.dates import parse_dates, parse_epoch_micros, recognise_dates
from chartmill.sources.sinks import write_dataset
from chartmill.sources.tables import column_list, read_csv, read_table

__all__ = [
    "aggregate",
    "aggregate_all",
    "apply_filters",
    "area_series",
    "bar_series",
    "batch_status",
    "build_chart",
    "build_session",
    "chart_batch",
    "check_chart",
    "check_spec",
    "cohorts",
    "column_list",
    "dense_ids",
    "derive",
    "distinct_ids",
    "funnel",
    "funnel_conversion",
    "funnel_counts",
    "heatmap",
    "heatmap_cells",
    "hour_weekday",
    "id_bitmaps",
    "join_sources",
    "legend",
    "line_series",
    "load_spec",
    "long_form",
    "merge_bitmaps",
    "merge_sketches",
    "ordered_funnel",
    "ordered_funnel_conversion",
    "parse_dates",
    "parse_epoch_micros",
    "period_series",
    "publish_batch",
    "quantile_series",
    "quantile_sketch",
    "quantiles",
    "read_csv",
    "read_published",
    "read_table",
    "recognise_dates",
    "register_functions",
    "retention",
    "retention_table",
    "rolling_distinct",
    "row_counts",
    "scatter_extent",
    "scatter_points",
    "series_keys",
    "session_hours",
    "sessions",
    "sketch_quantile",
    "sort_limit",
    "stacked_bar",
    "step_reached",
    "transform",
    "value_extent",
    "with_bins",
    "with_intensity",
    "with_retention_intensity",
    "write_batch",
    "write_dataset",
]
