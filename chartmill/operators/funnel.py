"""Conversion funnels over a given list of steps.

The list of steps comes from the caller, so a funnel is one conditional sum per
step: a single pass with map-side totals, and one row of totals that is then
ordered and unfolded. No join, no window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.columns import named, require_numeric

AS_GIVEN = "given"
BY_VALUE = "value"

StepOrder = str | Sequence[int]


def check_step_order(order: Sequence[int], step_count: int) -> None:
    if len(order) != step_count:
        raise ValueError(f"step order has {len(order)} entries for {step_count} steps")
    if sorted(order) != list(range(step_count)):
        raise ValueError(f"step order must name each of 0..{step_count - 1} once, got {list(order)}")


def _totals(df: DataFrame, steps: Sequence[str], step_col: str, measure) -> DataFrame:
    """One row with ``funnel``: an array of (given, step, value)."""
    if not steps:
        raise ValueError("a funnel needs at least one step")
    step = named(step_col).cast("string")
    entries = [
        F.struct(F.lit(i).alias("given"), F.lit(name).alias("step"), measure(step == name).alias("value"))
        for i, name in enumerate(steps)
    ]
    return df.filter(step.isin(list(steps))).agg(F.array(*entries).alias("funnel"))


def _ordered(totals: DataFrame, step_count: int, step_order: StepOrder) -> DataFrame:
    funnel = F.col("funnel")
    if step_order == BY_VALUE:
        # Largest first; equal values stay in the order given.
        keyed = F.transform(
            funnel, lambda s: F.struct((-s["value"]).alias("rank"), s["given"], s["step"], s["value"])
        )
        funnel = F.array_sort(keyed)
    elif step_order != AS_GIVEN:
        order = list(step_order)
        check_step_order(order, step_count)
        funnel = F.array(*[funnel[index] for index in order])
    placed = F.transform(
        funnel, lambda s, i: F.struct(i.alias("pos"), s["step"].alias("step"), s["value"].alias("value"))
    )
    return totals.select(placed.alias("funnel"))


def _funnel(df, steps, step_col, values, step_order) -> DataFrame:
    require_numeric(df, values)
    value = named(values).cast("double")
    totals = _totals(df, steps, step_col, lambda hit: F.coalesce(F.sum(F.when(hit, value)), F.lit(0.0)))
    return _ordered(totals, len(steps), BY_VALUE if step_order is None else step_order)


def funnel(
    df: DataFrame, steps: Sequence[str], step_col: str, values: str, step_order: StepOrder | None = None
) -> DataFrame:
    """pos, step, value for each named step; absent steps give 0.

    ``step_order`` is "value" (largest first, the default), "given", or a list
    of indices into ``steps``.
    """
    return _funnel(df, steps, step_col, values, step_order).select(F.inline("funnel"))


def _percent(part: Column, whole: Column) -> Column:
    return 100 * part / F.nullif(whole, F.lit(0.0))


def funnel_conversion(
    df: DataFrame, steps: Sequence[str], step_col: str, values: str, step_order: StepOrder | None = None
) -> DataFrame:
    """The funnel with rates in percent.

    step_rate: of the step before (NULL for the first); overall_rate: of the
    first step; width_ratio: of the largest value, 0..1; dropped and drop_rate:
    lost before the next step (NULL for the last). Empty when no step has a
    value above 0.
    """
    totals = _funnel(df, steps, step_col, values, step_order)
    funnel = F.col("funnel")
    widest = F.array_max(F.transform(funnel, lambda s: s["value"]))

    def measures(step: Column, i: Column) -> Column:
        value = step["value"]
        previous = F.get(funnel, i - 1)["value"]
        following = F.get(funnel, i + 1)["value"]
        return F.struct(
            step["pos"].alias("pos"),
            step["step"].alias("step"),
            value.alias("value"),
            _percent(value, previous).alias("step_rate"),
            _percent(value, funnel[0]["value"]).alias("overall_rate"),
            (value / widest).alias("width_ratio"),
            (value - following).alias("dropped"),
            _percent(value - following, value).alias("drop_rate"),
        )

    return totals.filter(widest > 0).select(F.inline(F.transform(funnel, measures)))
