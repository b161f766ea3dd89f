"""Quantiles of any period from a column of mergeable sketches, without going back to the rows.

A sketch counts values in buckets: every power of two is cut into ``steps`` equal parts, on
both sides of zero. Merging adds counts, so sketches of days give exactly the sketch
of their month, in any order. A quantile read from a sketch differs from the value of that rank
by at most 1 / (2 * steps) of it. Building, merging and reading are SQL functions and plain
aggregates with map-side totals; a sketch has at most one entry per bucket, however many rows it stands for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.columns import named, require_numeric
from chartmill.functions.grains import period_start

#: Parts of a power of two: quantiles are off by 0.8 % of themselves at most.
STEPS = 64
#: Below the least exponent of a double, so that bucket numbers of positive values are positive.
_LOWEST = 1075
SKETCH = "sketch"


def quantile_error(steps: int = STEPS) -> float:
    """The largest difference of a quantile from the value of its rank, relative to that value."""
    return 1 / (2 * steps)


def value_bucket(value: Column, steps: int = STEPS) -> Column:
    """The number of a value's bucket; numbers are ordered as the values are. 0 has a bucket of its own."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    # a logarithm next to a power of two can fall on its wrong side
    power = guess + (size >= F.pow(F.lit(2.0), guess + 1)).cast("long") - (size < F.pow(F.lit(2.0), guess)).cast("long")
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * steps)
    number = (power + _LOWEST) * steps + part + 1
    return F.when(size == 0, F.lit(0)).otherwise(F.when(value < 0, -number).otherwise(number)).cast("long")


def bucket_value(bucket: Column, steps: int = STEPS) -> Column:
    """The middle of a bucket."""
    number = F.abs(bucket) - 1
    power = F.floor(number / steps) - _LOWEST
    middle = F.pow(F.lit(2.0), power) * (1 + (number % steps + 0.5) / steps)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.when(bucket < 0, -middle).otherwise(middle))


def _collected(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias(SKETCH)
    return counts.groupBy(*map(named, keys)).agg(entries)


def quantile_sketch(df: DataFrame, keys: Sequence[str], value: str, steps: int = STEPS) -> DataFrame:
    """One row per key combination: the keys and ``sketch``. NULL and non-finite values are left out."""
    require_numeric(df, value)
    number = named(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    counts = (
        df.filter(finite)
        .groupBy(*map(named, keys), value_bucket(number, steps).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _collected(counts, keys)


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per combination of fewer or coarser keys; all sketches must have the same ``steps``."""
    counts = (
        sketches.select(*map(named, keys), F.inline(SKETCH))
        .groupBy(*map(named, keys), "bucket")
        .agg(F.sum("n").alias("n"))
    )
    return _collected(counts, keys)


def sketch_quantile(percent: float, steps: int = STEPS, sketch: str = SKETCH) -> Column:
    """The value of rank ceil(percent / 100 * n), the first at least, read from a sketch column."""
    if not 0 <= percent <= 100:
        raise ValueError(f"a percentile lies between 0 and 100, not at {percent}")
    entries = named(sketch)
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda seen, entry: seen + entry["n"])
    rank = F.greatest(F.ceil(total * F.lit(float(percent)) / 100), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bucket"))

    def step(state: Column, entry: Column) -> Column:
        seen = state["seen"] + entry["n"]
        hit = (state["seen"] < rank) & (seen >= rank)
        return F.struct(seen.alias("seen"), F.when(hit, entry["bucket"]).otherwise(state["bucket"]).alias("bucket"))

    return bucket_value(F.aggregate(entries, start, step)["bucket"], steps)


def quantiles(sketches: DataFrame, percents: Sequence[float], steps: int = STEPS) -> DataFrame:
    """The other columns, percent and value: one row per sketch and percentile."""
    keys = [named(name) for name in sketches.columns if name != SKETCH]
    pairs = [F.struct(F.lit(float(p)).alias("percent"), sketch_quantile(p, steps).alias("value")) for p in percents]
    return sketches.select(*keys, F.inline(F.array(*pairs)))


def quantile_series(
    df: DataFrame, ts: str, value: str, percents: Sequence[float], grain: str = "week", steps: int = STEPS
) -> DataFrame:
    """x, series, y: a line per percentile ("p50"), from sketches of days rolled up to periods."""
    days = quantile_sketch(df.withColumn("_day", period_start(named(ts), "day")), ["_day"], value, steps)
    periods = merge_sketches(days.withColumn("x", period_start(F.col("_day"), grain)), ["x"])
    label = F.format_string("p%s", F.regexp_replace(F.col("percent").cast("string"), r"\.0$", ""))
    return quantiles(periods, percents, steps).select("x", label.alias("series"), F.col("value").alias("y"))
