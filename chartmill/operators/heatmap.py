"""Heatmap cells with intensity and colour bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.columns import named, require_numeric
from chartmill.operators.aggregates import aggregate

MIN_BINS = 2
MAX_BINS = 100


def heatmap_cells(
    df: DataFrame, x: str, y: str, z: str, agg: str = "sum", large: bool | None = None
) -> DataFrame:
    """One cell (x, y, z) per pair; cells without any z are left out."""
    if agg != "count":
        require_numeric(df, z)
    picked = df.select(named(x).alias("x"), named(y).alias("y"), named(z).alias("z")).filter("z IS NOT NULL")
    cells = aggregate(picked, ["x", "y"], "z", agg, large)
    return cells.select("x", "y", F.col("z").cast("double").alias("z"))


def with_intensity(cells: DataFrame) -> DataFrame:
    """Add z scaled to [0, 1]; 0.5 everywhere when all z are equal.

    The upper end is at least 0. Both ends come from one scalar subquery that
    shares the shuffle of the cells.
    """
    upper = F.greatest(F.max("z"), F.lit(0.0))
    ends = cells.agg(F.struct(F.min("z").alias("lo"), upper.alias("hi"))).scalar()
    lo, hi = ends["lo"], ends["hi"]
    return cells.withColumn(
        "intensity", F.when(hi > lo, (F.col("z") - lo) / (hi - lo)).otherwise(F.lit(0.5))
    )


def with_bins(cells: DataFrame, bins: int = 10) -> DataFrame:
    """Add ``bin`` in 1..bins from equal slices of the intensity."""
    if not MIN_BINS <= bins <= MAX_BINS:
        raise ValueError(f"bins must be between {MIN_BINS} and {MAX_BINS}, got {bins}")
    slot = F.floor(F.col("intensity") * bins) + 1
    return cells.withColumn("bin", F.least(slot, F.lit(bins)).cast("int"))


def heatmap(
    df: DataFrame, x: str, y: str, z: str, bins: int = 10, agg: str = "sum", large: bool | None = None
) -> DataFrame:
    """x, y, z, intensity, bin."""
    return with_bins(with_intensity(heatmap_cells(df, x, y, z, agg, large)), bins)
