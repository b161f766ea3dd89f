"""Dense two-key grids: every row key with every column key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots per side of the join that pairs the axes, at least and at most; powers of two.
MIN_SIDE, MAX_SIDE = 4, 64


def _side(spark: SparkSession) -> int:
    """Slots per side, a power of two: their square is at least the number of shuffle partitions the session starts with."""
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    parts = int(parts or spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_SIDE, max(MIN_SIDE, 1 << ((parts - 1).bit_length() + 1) // 2))


def axis(cells: DataFrame, key: str, value: str) -> DataFrame:
    """key, total: the distinct keys of one axis.

    The total keeps the value column in this branch (the filter keeps the
    total), so the plan below the cells' shuffle equals that of the main branch
    and the shuffle is reused: the source is scanned once.
    """
    return cells.groupBy(key).agg(F.sum(value).alias("total")).filter(F.col("total").isNotNull())


def axis_pairs(rows: DataFrame, cols: DataFrame, row: str, col: str) -> DataFrame:
    """Every row of ``rows`` with every row of ``cols``, each holding distinct keys.

    An equi-join on a pair of slots: a key is hashed to one slot of its own side and
    repeated for each slot of the other. However few keys one axis has, the pairs
    are made by at least as many tasks as a side has slots; neither axis has to fit one task.
    """
    side = _side(rows.sparkSession)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long")))

    def own(key: str) -> Column:
        # The hash is never NULL, and neither is the slot: no filter is derived from the join.
        return F.xxhash64(key).bitwiseAND(F.lit(side - 1).cast("long"))

    left = rows.withColumn("_row_slot", own(row)).withColumn("_col_slot", every)
    right = cols.withColumn("_col_slot", own(col)).withColumn("_row_slot", every)
    return left.join(right, ["_row_slot", "_col_slot"]).drop("_row_slot", "_col_slot")


def dense_grid(cells: DataFrame, row: str, col: str, value: str, by_row: bool = False) -> DataFrame:
    """Complete aggregated ``cells`` with zeros: row, col, value.

    ``cells`` holds one row per (row, col) with a non-null value. The result has
    |rows| x |cols| rows by definition: ask for the sparse form where that is too many. The
    output is spread by both keys, or by the row key alone with ``by_row``, for windows over the rows.
    """
    rows, cols = axis(cells, row, value).select(row), axis(cells, col, value).select(col)
    blank = axis_pairs(rows, cols, row, col).select(row, col, F.lit(0.0).alias(value))
    every = cells.select(row, col, value).unionByName(blank)
    return (every.repartition(F.col(row)) if by_row else every).groupBy(row, col).agg(F.sum(value).alias(value))
