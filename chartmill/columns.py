"""Column references by exact name and checks on column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """The column called exactly ``name``, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    """Type of a column; a missing one raises Spark's own error with suggestions."""
    return df.select(named(name)).schema[0].dataType


def require_numeric(df: DataFrame, name: str) -> None:
    kind = type_of(df, name)
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"column '{name}' is {kind.simpleString()}; a numeric column is needed")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def chart_value(column: Column) -> Column:
    """A drawable number: double, with 0 for a missing value."""
    return F.coalesce(column.cast("double"), F.lit(0.0))


def join_on(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", small_right: bool = False
) -> DataFrame:
    """Add the other columns of ``right`` where all ``keys`` agree; NULL agrees with NULL.

    ``small_right`` asks for a broadcast; pass it only for a side of measured size.
    """
    own = {key: f"_right_{i}" for i, key in enumerate(keys)}
    right = right.select(*[named(name).alias(own.get(name, name)) for name in right.columns])
    if small_right:
        right = F.broadcast(right)
    condition = F.lit(True)
    for key, other in own.items():
        condition = condition & named(key).eqNullSafe(F.col(other))
    return left.join(right, condition, how).drop(*own.values())
