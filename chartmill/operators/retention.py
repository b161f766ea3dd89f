"""Cohort retention matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.columns import chart_value, named, require_numeric
from chartmill.operators.aggregates import aggregate
from chartmill.operators.grid import axis, axis_pairs, dense_grid


def _cells(df: DataFrame, cohort: str, period: str, users: str) -> DataFrame:
    """cohort, period, users: one row per present cell."""
    require_numeric(df, period)
    require_numeric(df, users)
    no_period = F.raise_error(F.lit(f"column '{period}' has rows without a period number"))
    checked = F.when(named(period).isNull(), no_period).otherwise(named(period))
    picked = df.select(
        named(cohort).alias("cohort"), checked.cast("int").alias("period"), named(users).alias("users")
    )
    return aggregate(picked, ["cohort", "period"], "users", "sum").select(
        "cohort", "period", chart_value(F.col("users")).alias("users")
    )


def _percentage(users: str) -> Column:
    """Relative to the cohort's size; 0 for a baseline that is not positive."""
    return F.when(F.col("cohort_size") > 0, 100 * F.col(users) / F.col("cohort_size")).otherwise(F.lit(0.0))


def retention(
    df: DataFrame, cohort: str, period: str, users: str, percentage: bool = True, intensity: bool = False
) -> DataFrame:
    """The dense cohort x period matrix.

    cohort, period, users - and with ``percentage`` also cohort_size, the users
    of the cohort's earliest present period, and retention_pct relative to it (0
    for a baseline that is not positive). A missing cell counts 0 users; a
    missing period number is an error. ``intensity`` adds retention_pct relative to the largest
    one; the matrix is then empty when that is 0.

    Sizes and the largest percentage come from the present cells, one row per cohort; blanks are 0
    and change neither. The result has |cohorts| x |periods| rows.
    """
    cells = _cells(df, cohort, period, users)
    if not (percentage or intensity):
        return dense_grid(cells, "cohort", "period", "users").orderBy("cohort", "period")
    sizes = cells.groupBy("cohort").agg(
        F.min_by("users", "period").alias("cohort_size"), F.max("users").alias("most")
    )
    periods = axis(cells, "period", "users").select("period")
    # every pair has a blank cell, which brings the cohort's size along
    blank = axis_pairs(sizes.select("cohort", "cohort_size"), periods, "cohort", "period")
    every = cells.withColumn("cohort_size", F.lit(None).cast("double")).unionByName(blank.withColumn("users", F.lit(0.0)))
    matrix = every.groupBy("cohort", "period").agg(F.sum("users").alias("users"), F.max("cohort_size").alias("cohort_size"))
    matrix = matrix.withColumn("retention_pct", _percentage("users"))
    if intensity:
        largest = sizes.agg(F.max(_percentage("most"))).scalar()
        matrix = matrix.filter(largest > 0).withColumn("intensity", F.col("retention_pct") / largest)
    return matrix.orderBy("cohort", "period")


def with_retention_intensity(matrix: DataFrame) -> DataFrame:
    """Add retention_pct relative to the largest one; empty when that is 0.

    For a matrix at hand; ``retention(..., intensity=True)`` finds the largest before the blanks are added.
    """
    largest = matrix.agg(F.max("retention_pct")).scalar()
    return matrix.filter(largest > 0).withColumn("intensity", F.col("retention_pct") / largest)


def retention_table(
    matrix: DataFrame, values: str = "retention_pct", periods: Sequence[int] | None = None
) -> DataFrame:
    """One row per cohort and a column ``period_<n>`` per period.

    ``periods`` fixes the columns; a row with a period that is not among them stops the query. Otherwise
    Spark looks the period numbers up first (its own pivot limit applies).
    """
    if periods is not None:
        stray = F.raise_error(F.concat(F.lit("no column for period "), F.col("period").cast("string")))
        known = F.col("period").isin(*periods) if periods else F.lit(False)
        matrix = matrix.withColumn("period", F.when(known, F.col("period")).otherwise(stray.cast("int")))
    wide = matrix.groupBy("cohort").pivot("period", list(periods) if periods is not None else None)
    table = wide.agg(F.first(named(values)))
    return table.select(
        "cohort", *[named(name).alias(f"period_{name}") for name in table.columns if name != "cohort"]
    ).orderBy("cohort")
