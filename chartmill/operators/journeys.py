"""Sessions and ordered funnels from raw events.

Both cut time into buckets, so that a user with very many events occupies many tasks: sessions
by buckets as long as the gap, whose events belong together whatever lies between them, and
funnels by buckets as long as their window, of which a chain of steps touches two at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.columns import named, require_numeric, type_of
from chartmill.operators.funnel import AS_GIVEN, _ordered, funnel_conversion

_MICROS = 1_000_000


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970, of timestamps with and without a time zone."""
    if isinstance(type_of(df, ts), T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), named(ts))
    return F.unix_micros(named(ts).cast("timestamp"))


def sessions(events: DataFrame, user: str, ts: str, gap_minutes: float = 30, value: str | None = None) -> DataFrame:
    """user, session, started, ended, events[, value]: runs of a user's events with pauses of ``gap_minutes`` at most.

    ``session`` counts from 1 per user. Events are reduced to one row per user and
    bucket of the gap's length before anything is sorted; what remains of a user is bounded by the
    calendar. Rows without a user or time are left out. ``value`` is summed, without any 0.
    """
    gap = round(gap_minutes * 60 * _MICROS)
    if gap <= 0:
        raise ValueError("the gap between sessions must be positive")
    sums = {}
    if value is not None:
        require_numeric(events, value)
        sums["value"] = F.sum(named(value).cast("double"))
    moment = _micros(events, ts)
    pieces = (
        events.filter(named(user).isNotNull() & named(ts).isNotNull())
        .groupBy(named(user).alias("user"), F.floor(moment / gap).alias("_bucket"))
        .agg(
            F.min(named(ts)).alias("started"),
            F.max(named(ts)).alias("ended"),
            F.min(moment).alias("_first"),
            F.max(moment).alias("_last"),
            F.count(F.lit(1)).alias("events"),
            *[total.alias(name) for name, total in sums.items()],
        )
    )
    in_order = Window.partitionBy("user").orderBy("_bucket")
    begins = F.coalesce(F.col("_first") - F.lag("_last").over(in_order) > gap, F.lit(True)).cast("int")
    numbered = pieces.withColumn("_begins", begins).withColumn("session", F.sum("_begins").over(in_order))
    return numbered.groupBy("user", "session").agg(
        F.min("started").alias("started"),
        F.max("ended").alias("ended"),
        F.sum("events").alias("events"),
        *[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in sums],
    )


def session_hours(table: DataFrame) -> DataFrame:
    """hour (0-23), weekday (0 is Monday), sessions, events: when sessions start, ready for a heatmap."""
    return (
        table.groupBy(F.hour("started").alias("hour"), F.weekday("started").alias("weekday"))
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("events").alias("events"))
    )


def step_reached(events: DataFrame, user: str, ts: str, step_col: str, steps: Sequence[str], hours: float) -> DataFrame:
    """user, reached: the most steps, from the first one on and in order, that a user took within ``hours``.

    Each step must come later than the one before, and no more than ``hours`` after the first. For every
    event the latest start of a chain that ends with it is carried along - a later start leaves more time -
    by one window per step, all over the same partitioning and order.
    """
    if not steps:
        raise ValueError("a funnel needs at least one step")
    width = round(hours * 3600 * _MICROS)
    if width <= 0:
        raise ValueError("the window of a funnel must be positive")
    step, moment = named(step_col).cast("string"), _micros(events, ts)
    own = F.floor(F.col("_at") / width)
    placed = (
        events.select(named(user).alias("user"), moment.alias("_at"), step.alias("_step"))
        .filter(F.col("_step").isin(list(steps)) & F.col("user").isNotNull() & F.col("_at").isNotNull())
        .distinct()
        # a chain that starts in a bucket ends there or in the next one, which therefore comes along
        .withColumn("_bucket", F.explode(F.array(own, own - 1)))
        .withColumn("_start0", F.when((F.col("_step") == steps[0]) & (F.col("_bucket") == own), F.col("_at")))
    )
    earlier = Window.partitionBy("user", "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    for i, name in enumerate(steps[1:], 1):
        start = F.max(f"_start{i - 1}").over(earlier)
        placed = placed.withColumn(f"_start{i}", F.when((F.col("_step") == name) & (F.col("_at") - start <= width), start))
    depth = F.coalesce(*[F.when(F.col(f"_start{i}").isNotNull(), F.lit(i + 1)) for i in reversed(range(len(steps)))], F.lit(0))
    return placed.groupBy("user").agg(F.max(depth).alias("reached"))


def ordered_funnel(events: DataFrame, user: str, ts: str, step_col: str, steps: Sequence[str], hours: float) -> DataFrame:
    """pos, step, value: users who took this step after all before it, in order and within ``hours`` of the first."""
    reached = step_reached(events, user, ts, step_col, steps, hours)
    entries = [
        F.struct(F.lit(i).alias("given"), F.lit(name).alias("step"), F.count_if(F.col("reached") > i).alias("value"))
        for i, name in enumerate(steps)
    ]
    return _ordered(reached.agg(F.array(*entries).alias("funnel")), len(steps), AS_GIVEN).select(F.inline("funnel"))


def ordered_funnel_conversion(
    events: DataFrame, user: str, ts: str, step_col: str, steps: Sequence[str], hours: float
) -> DataFrame:
    """The ordered funnel with the rates of ``funnel_conversion``; step names must differ."""
    counts = ordered_funnel(events, user, ts, step_col, steps, hours)
    return funnel_conversion(counts, steps, "step", "value", AS_GIVEN)
