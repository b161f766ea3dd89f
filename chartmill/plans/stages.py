"""The fixed stage order: filter, derive, aggregate, sort, limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from chartmill.functions.derive import derive
from chartmill.operators.aggregates import aggregate
from chartmill.operators.filters import apply_filters
from chartmill.operators.ordering import sort_limit


def prepare(
    df: DataFrame, filters: Mapping[str, Any] | None = None, derived: Mapping[str, str] | None = None
) -> DataFrame:
    """Filters on source columns, then derived columns."""
    if filters:
        df = apply_filters(df, filters.get("include"), filters.get("exclude"), filters.get("expression"))
    return derive(df, derived) if derived else df


def sort_keys(sort: Sequence[Mapping[str, Any]] | None, renamed: Mapping[str, str] | None = None):
    """(column, ascending) pairs from sort entries; ascending is the default."""
    renamed = renamed or {}
    keys = []
    for entry in sort or ():
        ascending = entry.get("ascending")
        keys.append((renamed.get(entry["column"], entry["column"]), True if ascending is None else ascending))
    return keys


def transform(
    df: DataFrame,
    filter: Mapping[str, Any] | None = None,
    derive: Mapping[str, str] | None = None,
    x: str | None = None,
    y: str | None = None,
    group_by: str | Sequence[str] | None = None,
    agg: str | None = None,
    sort: Sequence[Mapping[str, Any]] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """All stages on one table.

    With ``agg`` the rows are grouped by ``group_by``, or by ``x`` where that is
    not given; without ``agg`` they pass through.
    """
    df = prepare(df, filter, derive)
    keys = group_by if group_by is not None else x
    if agg is not None:
        if keys is None or y is None:
            raise ValueError("aggregation needs 'y' and one of 'x' and 'group_by'")
        df = aggregate(df, keys, y, agg)
    return sort_limit(df, sort_keys(sort), limit)
