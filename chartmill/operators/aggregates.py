"""Grouped aggregation of one value column or of all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.columns import is_numeric, join_on, named, require_numeric
from chartmill.operators.median import grouped_median
from chartmill.sizing import is_small

AGGREGATES = {
    "sum": F.sum,
    "count": F.count,
    "mean": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
}
NUMERIC_ONLY = {"sum", "mean", "median"}
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def check_aggregate(agg: str) -> None:
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregation '{agg}'; supported: {', '.join(AGGREGATES)}")


def _key_list(keys: str | Sequence[str]) -> list[str]:
    listed = [keys] if isinstance(keys, str) else list(keys)
    if not listed:
        raise ValueError("grouping needs at least one key")
    return listed


def aggregate(
    df: DataFrame, keys: str | Sequence[str], value: str, agg: str | None = "sum", large: bool | None = None
) -> DataFrame:
    """One row per key combination; the result keeps the value column's name.

    Without an aggregation function the rows pass through. NULL values are
    skipped, and ``count`` counts the others. ``large`` chooses the plan of medians in place of the
    measured size.
    """
    if agg is None:
        return df
    check_aggregate(agg)
    keys = _key_list(keys)
    if value in keys:
        raise ValueError(f"'{value}' cannot be both a key and the aggregated value")
    if agg in NUMERIC_ONLY:
        require_numeric(df, value)
    if agg == "median":
        return grouped_median(df, keys, value, large)
    return df.groupBy(*map(named, keys)).agg(AGGREGATES[agg](named(value)).alias(value))


def aggregate_all(df: DataFrame, key: str, agg: str, large: bool | None = None) -> DataFrame:
    """Aggregate every column but the key with one function.

    Sum, mean and median apply to the numeric columns only. ``large=True`` selects medians by rank whatever the
    size. Else the measured size decides, also against ``large=False``: Spark's own median keeps the values of
    all columns of a group in one task, which only a small input bears.
    """
    check_aggregate(agg)
    values = [
        field.name
        for field in df.schema.fields
        if field.name != key and (agg not in NUMERIC_ONLY or is_numeric(field.dataType))
    ]
    if not values:
        raise ValueError(f"no column left to aggregate by '{key}'")
    if agg in ("min", "max"):
        return _extremes(df, key, values, agg)
    if agg != "median" or (not large and is_small(df)):
        return _each(df, key, values, agg)
    # Long form, so that all columns share the passes of the rank selection.
    long = df.select(
        named(key), F.explode(F.create_map(*_name_value_pairs(values))).alias("_column", "_value")
    )
    medians = grouped_median(long, [key, "_column"], "_value", large=True)
    wide = medians.groupBy(named(key)).pivot("_column", values).agg(F.first("_value"))
    return wide.select(named(key), *[named(name) for name in values])


def _each(df: DataFrame, key: str, values: list[str], agg: str) -> DataFrame:
    return df.groupBy(named(key)).agg(*[AGGREGATES[agg](named(name)).alias(name) for name in values])


def _extremes(df: DataFrame, key: str, values: list[str], agg: str) -> DataFrame:
    """Smallest or largest of every column.

    Spark sorts its input to find the extremes of texts. They are found apart
    from the columns of fixed width, so that only key and texts are sorted and
    the rest is hashed; each half reads its own columns.
    """
    fixed = [name for name in values if isinstance(df.schema[name].dataType, FIXED_WIDTH)]
    texts = [name for name in values if name not in fixed]
    if not fixed or not texts:
        return _each(df, key, values, agg)
    both = join_on(_each(df, key, fixed, agg), _each(df, key, texts, agg), [key])
    return both.select(named(key), *map(named, values))


def _name_value_pairs(values: list[str]) -> list:
    pairs = []
    for name in values:
        pairs += [F.lit(name), named(name).cast("double")]
    return pairs
