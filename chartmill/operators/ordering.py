"""Sorting, limits and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from chartmill.columns import named

SortKey = tuple[str, bool]


def _direction(column: str, ascending: bool) -> Column:
    return named(column).asc() if ascending else named(column).desc()


def sort_limit(df: DataFrame, keys: Sequence[SortKey] = (), limit: int | None = None) -> DataFrame:
    """Sort by ``keys`` (first key is primary) and keep the first ``limit`` rows.

    With a limit the remaining columns break ties, so the same rows are kept on
    every run. Sort plus limit plans as a distributed top-k.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    order = [_direction(column, ascending) for column, ascending in keys]
    if limit is None:
        return df.orderBy(*order) if order else df
    used = {column for column, _ in keys}
    for field in df.schema.fields:
        if field.name not in used and not isinstance(field.dataType, T.MapType):
            order.append(named(field.name).asc())
    return df.orderBy(*order).limit(limit)
