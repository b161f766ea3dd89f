"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.columns import join_on, named
from chartmill.operators.running import running_total
from chartmill.sizing import is_small, settled

BRACKET = 0.001
SKETCH_ACCURACY = 10_000
BROADCAST_BYTES = 32 * 1024 * 1024
ROW_OVERHEAD = 96
SALTS = 32

BELOW, INSIDE, ABOVE = 0, 1, 2
TARGET_COLUMNS = ("_first_zone", "_first_rank", "_second_zone", "_second_rank")


def grouped_median(df: DataFrame, keys: list[str], value: str, large: bool | None = None) -> DataFrame:
    """keys + ``value``: the interpolated median of the non-null values per group.

    Spark's own ``median`` keeps every distinct value of a group in one task. It
    is used while the whole input is small; beyond that the median is selected
    by rank (see ``_selected``), which runs jobs. ``large`` chooses the plan in place of the
    measured size.
    """
    if is_small(df, large):
        return df.groupBy(*map(named, keys)).agg(F.median(named(value)).alias(value))
    return _selected(df, keys, value)


def _selected(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median by rank selection in two scans, exact whatever the sketch returns.

    1. A quantile sketch per group gives a narrow bracket around the middle.
    2. Rows below and above the bracket are counted, those inside are counted
       per value. The counts tell which zone holds the middle ranks.
    3. Should that not be the bracket for some group, the rows of the right zone
       are counted per value in another scan.
    4. The values found are ranked by a running total of their counts.
    """
    rows = df.select(*map(named, keys), named(value).cast("double").alias("_v"))
    groups = settled(
        rows.groupBy(*map(named, keys)).agg(
            F.percentile_approx("_v", [0.5 - BRACKET, 0.5 + BRACKET], SKETCH_ACCURACY).alias("_b")
        )
    ).select(*map(named, keys), F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    small = _measured_bytes(groups, keys) <= BROADCAST_BYTES

    present = rows.filter(F.col("_v").isNotNull())
    if small:
        present = present.withColumn("_copies", F.lit(1).cast("long"))
    else:
        # The groups will be joined by a shuffle: reduce equal values first.
        present = present.groupBy(*map(named, keys), "_v").agg(F.count(F.lit(1)).alias("_copies"))
    zoned = _attach(present, groups, keys, small).withColumn("_zone", _zone())
    inside_value = F.when(F.col("_zone") == INSIDE, F.col("_v")).alias("_v")
    counted = settled(
        zoned.groupBy(*map(named, keys), "_lo", "_hi", "_zone", inside_value).agg(
            F.sum("_copies").alias("_copies")
        )
    )
    targets = settled(_targets(counted, keys))
    missed = (F.col("_first_zone") != INSIDE) | (F.col("_second_zone") != INSIDE)
    if targets.filter(missed).isEmpty():
        values = join_on(counted.drop("_lo", "_hi"), targets.drop("_lo", "_hi"), keys, small_right=small)
        values = values.filter(F.col("_zone") == INSIDE)
    else:
        wanted = (F.col("_zone") == F.col("_first_zone")) | (F.col("_zone") == F.col("_second_zone"))
        values = (
            _attach(present, targets, keys, small)
            .withColumn("_zone", _zone())
            .filter(wanted)
            .groupBy(*map(named, keys), "_zone", "_v", *TARGET_COLUMNS)
            .agg(F.sum("_copies").alias("_copies"))
        )
    ranked = running_total(values, keys + ["_zone"], ["_v"], "_copies")
    middle = ranked.groupBy(*map(named, keys)).agg(
        F.max(_at("_first")).alias("_a"), F.max(_at("_second")).alias("_c")
    )
    return join_on(groups, middle, keys, "left").select(
        *map(named, keys), ((F.col("_a") + F.col("_c")) / 2).alias(value)
    )


def _targets(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the zones that hold the middle ranks and the ranks within them."""

    def rows_in(zone: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_zone") == zone, F.col("_copies"))), F.lit(0))

    sums = counted.groupBy(*map(named, keys), "_lo", "_hi").agg(
        rows_in(BELOW).alias("_below"), rows_in(INSIDE).alias("_inside"), F.sum("_copies").alias("_n")
    )
    return sums.select(
        *map(named, keys),
        "_lo",
        "_hi",
        *_target("_first", F.expr("(_n + 1) div 2")),
        *_target("_second", F.expr("_n div 2 + 1")),
    )


def _measured_bytes(groups: DataFrame, keys: list[str]) -> int:
    key_bytes = F.length(F.to_json(F.struct(*map(named, keys))))
    return groups.select(F.sum(key_bytes + ROW_OVERHEAD)).first()[0] or 0


def _zone() -> Column:
    return F.when(F.col("_v") < F.col("_lo"), BELOW).when(F.col("_v") <= F.col("_hi"), INSIDE).otherwise(ABOVE)


def _target(name: str, rank: Column) -> list[Column]:
    """Zone of a rank and the rank counted from the start of that zone."""
    through_inside = F.col("_below") + F.col("_inside")
    zone = F.when(rank <= F.col("_below"), BELOW).when(rank <= through_inside, INSIDE).otherwise(ABOVE)
    start = F.when(rank <= F.col("_below"), 0).when(rank <= through_inside, F.col("_below")).otherwise(through_inside)
    return [zone.alias(f"{name}_zone"), (rank - start).alias(f"{name}_rank")]


def _at(name: str) -> Column:
    rank = F.col(f"{name}_rank")
    hit = (F.col("_zone") == F.col(f"{name}_zone")) & (F.col("before") < rank) & (rank <= F.col("until"))
    return F.when(hit, F.col("_v"))


def _attach(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Give every row its group's figures.

    The group table is broadcast when its measured size allows. Otherwise both
    sides are shuffled, and the values of one group are spread over ``SALTS``
    partitions so that a hot group does not land in one task.
    """
    if small:
        return join_on(rows, groups, keys, small_right=True)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    groups = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(rows, groups, keys + ["_salt"]).drop("_salt")
