"""Row filters: include lists, exclude lists and SQL conditions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.columns import named, type_of

FilterValues = str | Sequence[str]


def as_values(column: str, values: FilterValues) -> list[str]:
    """Normalise one value or a list of values; nothing may be empty."""
    listed = [values] if isinstance(values, str) or not isinstance(values, Sequence) else list(values)
    if not column:
        raise ValueError("a filter needs a column name")
    if not listed or any(value is None or value == "" for value in listed):
        raise ValueError(f"filter on '{column}' needs non-empty values")
    return [str(value) for value in listed]


def _keep(df: DataFrame, column: str, values: list[str]) -> Column:
    kind = type_of(df, column)
    if isinstance(kind, T.StringType):
        return named(column).isin(values)
    # A value that is no such type becomes NULL and therefore matches no row.
    return named(column).isin([F.lit(value).try_cast(kind) for value in values])


def _drop(df: DataFrame, column: str, values: list[str]) -> Column:
    kind = type_of(df, column)
    if isinstance(kind, T.StringType):
        return ~named(column).isin(values)
    kept = F.lit(True)
    for value in values:
        literal = F.lit(value).try_cast(kind)
        # Folded by the optimizer: an unfitting value excludes nothing.
        kept = kept & F.when(literal.isNull(), True).otherwise(named(column) != literal)
    return kept & named(column).isNotNull()


def apply_filters(
    df: DataFrame,
    include: Mapping[str, FilterValues] | None = None,
    exclude: Mapping[str, FilterValues] | None = None,
    expression: str | None = None,
) -> DataFrame:
    """Keep rows that meet every condition.

    ``include`` and ``exclude`` hold one value or a list per column, written as
    strings whatever the column's type. ``expression`` is a SQL condition.
    NULL cells fail both include and exclude, as in SQL.
    """
    for column, values in (include or {}).items():
        df = df.filter(_keep(df, column, as_values(column, values)))
    for column, values in (exclude or {}).items():
        df = df.filter(_drop(df, column, as_values(column, values)))
    if expression is not None:
        if not expression.strip():
            raise ValueError("the filter expression is empty")
        df = df.filter(F.expr(expression))
    return df
