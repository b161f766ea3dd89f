"""Registry of queries and helpers they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_schemas: dict[str, T.StructType] = {}


def query(key: str, sql: str) -> Callable[[Query], Query]:
    """Register a query and the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query '{key}' is registered twice")
        QUERIES[key] = function
        ORACLE_SQL[key] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is looked up in the files only once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def rounded(column: str | Column, digits: int = 4) -> Column:
    """Sums of doubles differ in the last bits with task order; compare them rounded."""
    return F.round(column, digits)


def steady(column: str | Column, digits: int = 4) -> Column:
    """Rounded means and ratios: these can end in a 5 right after the last digit kept.

    The noise is cut off as a decimal first, so the 5 always rounds up.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("decimal(30,8)"), digits).cast("double")


def steady_sql(expression: str, digits: int = 4) -> str:
    """The SQL text that rounds as ``steady`` does."""
    return f"CAST(round(CAST({expression} AS DECIMAL(30, 8)), {digits}) AS DOUBLE)"


def scratch(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, in the folder shared by all executors."""
    return f"{shared_dir(spark)}/workload-{uuid.uuid4().hex}/{name}"
