"""From raw events to the tables that funnels, cohorts and heatmaps start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.columns import named
from chartmill.functions.grains import period_start, periods_between
from chartmill.operators.funnel import AS_GIVEN, _ordered, _totals
from chartmill.operators.series import line_series


def cohorts(events: DataFrame, user: str, ts: str, grain: str = "week") -> DataFrame:
    """cohort, period_number, users: distinct active users by first-seen period.

    Events are reduced to each user's set of periods, map-side as well, so a user
    with very many events weighs as little as one with few. The set has at most one entry per
    period of the calendar.
    """
    active = (
        events.select(named(user).alias("_user"), period_start(named(ts), grain).alias("_period"))
        .filter("_user IS NOT NULL AND _period IS NOT NULL")
        .groupBy("_user")
        .agg(F.collect_set("_period").alias("_periods"))
    )
    return (
        active.select(F.array_min("_periods").alias("cohort"), F.explode("_periods").alias("_period"))
        .withColumn("period_number", periods_between(F.col("cohort"), F.col("_period"), grain))
        .groupBy("cohort", "period_number")
        .agg(F.count(F.lit(1)).alias("users"))
    )


def funnel_counts(events: DataFrame, steps: Sequence[str], step_col: str, user: str) -> DataFrame:
    """pos, step, value: distinct users with at least one event of each step.

    The distinct (step, user) pairs are built first, so the count per step is a
    plain one.
    """
    step = named(step_col).cast("string")
    pairs = (
        events.select(step.alias("_step"), named(user).alias("_user"))
        .filter(F.col("_step").isin(list(steps)) & F.col("_user").isNotNull())
        .distinct()
    )
    totals = _totals(pairs, steps, "_step", F.count_if)
    return _ordered(totals, len(steps), AS_GIVEN).select(F.inline("funnel"))


def hour_weekday(events: DataFrame, ts: str) -> DataFrame:
    """hour (0-23), weekday (0 is Monday), events: ready for a heatmap."""
    return (
        events.select(F.hour(named(ts)).alias("hour"), F.weekday(named(ts)).alias("weekday"))
        .groupBy("hour", "weekday")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def period_series(
    events: DataFrame, ts: str, value: str, grain: str = "week", group: str | None = None, agg: str = "sum"
) -> DataFrame:
    """A line per group with one point per period."""
    return line_series(events.withColumn("_period", period_start(named(ts), grain)), "_period", value, group, agg)
