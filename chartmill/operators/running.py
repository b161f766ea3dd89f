"""Running totals that also work when one group is too big for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartmill.columns import join_on, named
from chartmill.sizing import is_small, settled

MAX_WINDOW_ROWS = 1_000_000


def windowed_total(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """The running total by one window per group; each group passes through one task."""
    window = Window.partitionBy(*map(named, partition)).orderBy(*map(named, order))
    until_here = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(named(value)).over(before), F.lit(0))).withColumn(
        "until", F.sum(named(value)).over(until_here)
    )


def running_total(
    df: DataFrame, partition: list[str], order: list[str], value: str, large: bool | None = None
) -> DataFrame:
    """Add ``before`` and ``until``: the total of ``value`` without and with the row.

    Small inputs use a window. A large input is settled and its largest group
    counted; a group that is too big for a window is cut into ranges. ``large`` chooses in place of the
    measured size: False for one window, True for ranges.
    """
    if is_small(df, large):
        return windowed_total(df, partition, order, value)
    if large:
        return ranged_total(df, partition, order, value)
    df = settled(df)
    sizes = df.groupBy(*map(named, partition)).agg(F.count(F.lit(1)).alias("_size"))
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    if largest <= MAX_WINDOW_ROWS:
        return windowed_total(df, partition, order, value)
    return ranged_total(df, partition, order, value)


def ranged_total(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """The running total for groups of any size.

    The rows are cut into sorted ranges of even size and each range is summed.
    Every row adds the total of the earlier ranges of its group to the running
    total inside its own range.
    """
    # Range bounds are sampled and task numbers are not stable, hence the checkpoint.
    ranged = settled(
        df.repartitionByRange(*map(named, partition + order)).withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*map(named, partition), "_range").agg(F.sum(named(value)).alias("_total"))
    earlier = (
        Window.partitionBy(*map(named, partition))
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (group, range): as many per group as there are partitions.
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    joined = join_on(ranged, offsets, partition + ["_range"], "left")
    inside = windowed_total(joined, partition + ["_range"], order, value)
    return (
        inside.withColumn("before", F.col("before") + F.col("_offset"))
        .withColumn("until", F.col("until") + F.col("_offset"))
        .drop("_range", "_offset")
    )
