"""Several plain charts of one source from one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.columns import chart_value, named
from chartmill.operators.aggregates import AGGREGATES
from chartmill.plans.charts import DEFAULT_AGG

Chart = Mapping[str, Any]

#: Aggregates whose partial results are small; a median's are not.
FUSED_AGGREGATES = frozenset(AGGREGATES) - {"median"}


def is_plain(chart: Chart) -> bool:
    """A line, area or bar chart of one aggregate per key, neither stacked nor normalised."""
    stacked = chart.get("stacked")
    if chart["type"] == "area" and stacked is None:
        stacked = True
    return (
        chart["type"] in ("line", "area", "bar")
        and not stacked
        and not chart.get("normalize")
        and (chart.get("agg") or DEFAULT_AGG) in FUSED_AGGREGATES
    )


def _keys(chart: Chart) -> list[str]:
    return [chart["x"]] + ([chart["group_by"]] if chart.get("group_by") else [])


def fused_cells(prepared: DataFrame, charts: Sequence[Chart]) -> tuple[DataFrame, list]:
    """One aggregation for all charts over GROUPING SETS, and a function per chart that takes its cells from it.

    Each set of keys is grouped once, whatever number of charts uses it.
    """
    keys = sorted({key for chart in charts for key in _keys(chart)})
    sets = sorted({tuple(sorted(set(_keys(chart)))) for chart in charts})
    values = sorted({(chart["y"], chart.get("agg") or DEFAULT_AGG) for chart in charts})
    place = {key: f"k{i}" for i, key in enumerate(keys)}
    source = prepared.select(
        *[named(key).alias(name) for key, name in place.items()],
        *[named(y).alias(f"v{i}") for i, (y, _) in enumerate(values)],
    )
    grouped = source.groupingSets([[F.col(place[key]) for key in one] for one in sets], *place.values()).agg(
        F.grouping_id().alias("which"), *[AGGREGATES[agg](f"v{i}").alias(f"a{i}") for i, (_, agg) in enumerate(values)]
    )

    def taker(chart: Chart):
        own = _keys(chart)
        # a bit for each key column, the first one highest, set where the column is not grouped by
        which = sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in own)
        value = f"a{values.index((chart['y'], chart.get('agg') or DEFAULT_AGG))}"
        names = list(zip(own, ("x", "series")))

        def cells(table: DataFrame) -> DataFrame:
            picked = [F.col(place[key]).alias(name) for key, name in names]
            return table.filter(F.col("which") == which).select(*picked, chart_value(F.col(value)).alias("y"))

        return cells

    return grouped, [taker(chart) for chart in charts]
