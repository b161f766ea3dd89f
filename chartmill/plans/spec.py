"""Chart specifications: plain dictionaries and the rules they must meet."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from chartmill.operators.aggregates import check_aggregate
from chartmill.operators.filters import as_values
from chartmill.operators.funnel import check_step_order
from chartmill.operators.heatmap import MAX_BINS, MIN_BINS

# The chart types and the fields each cannot do without.
REQUIRED_FIELDS = {
    "line": ("x", "y"),
    "area": ("x", "y"),
    "bar": ("x", "y"),
    "bar-stacked": ("x", "y", "group_by"),
    "heatmap": ("x", "y", "z"),
    "scatter": ("x", "y"),
    "funnel": ("steps", "values"),
    "retention": ("cohort_date", "period_number", "users"),
}

Chart = Mapping[str, Any]


def load_spec(path: str) -> dict[str, Any]:
    """A spec from a JSON or YAML file on the driver."""
    with open(path, encoding="utf-8") as file:
        if path.endswith(".json"):
            return json.load(file)
        import yaml

        return yaml.safe_load(file)


def check_chart(chart: Chart) -> None:
    kind = chart.get("type")
    if kind not in REQUIRED_FIELDS:
        raise ValueError(f"'{kind}' is not a chart type; supported: {', '.join(REQUIRED_FIELDS)}")
    for field in REQUIRED_FIELDS[kind]:
        if not chart.get(field):
            raise ValueError(f"{kind} charts need '{field}'")
    if chart.get("agg") is not None:
        check_aggregate(chart["agg"])
    bins = chart.get("bins")
    if bins is not None and not MIN_BINS <= bins <= MAX_BINS:
        raise ValueError(f"bins must be between {MIN_BINS} and {MAX_BINS}, got {bins}")
    if isinstance(chart.get("step_order"), (list, tuple)):
        check_step_order(chart["step_order"], len(chart.get("steps") or ()))
    if chart.get("filter") is not None:
        check_filter(chart["filter"])


def check_filter(block: Mapping[str, Any]) -> None:
    if not block.get("include") and not block.get("exclude") and block.get("expression") is None:
        raise ValueError("a filter needs an include, an exclude or an expression")
    for part in ("include", "exclude"):
        for column, values in (block.get(part) or {}).items():
            as_values(column, values)
    expression = block.get("expression")
    if expression is not None and not expression.strip():
        raise ValueError("the filter expression is empty")


def check_spec(spec: Mapping[str, Any]) -> None:
    """The first broken rule of a whole spec, with the number of the chart."""
    if not spec.get("charts"):
        raise ValueError("a spec needs at least one chart")
    for number, chart in enumerate(spec["charts"], start=1):
        try:
            check_chart(chart)
        except ValueError as problem:
            raise ValueError(f"chart {number}: {problem}") from problem
