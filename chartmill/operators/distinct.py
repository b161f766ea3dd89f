"""Exact distinct users of any union of periods, from one table of bitmaps.

A bitmap row stands for 32,768 consecutive ids of one key; a bit is an id that occurs. Bitmaps of
days are combined by OR into weeks, months or rolling windows, and counted there: no rows
are read again, and no user is counted twice. Ids are whole numbers; others, and
numbers spread too thinly, are numbered first by ``dense_ids``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.columns import named, type_of
from chartmill.sizing import settled

BUCKET, IDS = "bucket", "ids"


def dense_ids(df: DataFrame, id_col: str) -> DataFrame:
    """id, number: the distinct ids, numbered without gaps from 1.

    Each task numbers its own ids; only the tasks' totals are added up in one place.
    """
    ids = df.select(named(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    place = F.monotonically_increasing_id()
    # the numbering must not change between the two uses
    placed = settled(ids.select("id", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # one row per task that wrote ids
    return placed.join(F.broadcast(parts), "part").select("id", (F.col("start") + F.col("at") + 1).alias("number"))


def id_bitmaps(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The keys, bucket and ids (a bitmap): which ids each key combination has. NULL ids are left out."""
    kind = type_of(df, id_col)
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"column '{id_col}' is {kind.simpleString()}; number its values with dense_ids first")
    ident = named(id_col).cast("long")
    return (
        df.filter(ident.isNotNull())
        .groupBy(*map(named, keys), F.bitmap_bucket_number(ident).alias(BUCKET))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(ident)).alias(IDS))
    )


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The bitmaps of fewer or coarser keys."""
    return bitmaps.groupBy(*map(named, keys), BUCKET).agg(F.bitmap_or_agg(IDS).alias(IDS))


def distinct_ids(bitmaps: DataFrame, keys: Sequence[str], name: str = "users") -> DataFrame:
    """The keys and how many different ids they have in all their bitmaps together."""
    merged = merge_bitmaps(bitmaps, keys)
    return merged.groupBy(*map(named, keys)).agg(F.sum(F.bitmap_count(IDS)).alias(name))


def rolling_distinct(daily: DataFrame, day: str, days: int, keys: Sequence[str] = (), name: str = "users") -> DataFrame:
    """The day, the keys and the different ids of the ``days`` days that end with it, for every day that has ids at all."""
    if days < 1:
        raise ValueError("a rolling window covers at least one day")
    present = daily.select(named(day).alias("_end")).distinct()
    reach = F.explode(F.sequence(named(day), F.date_add(named(day), days - 1))).alias("_end")
    spread = daily.select(reach, *map(named, keys), BUCKET, IDS).join(present, "_end", "left_semi")
    return distinct_ids(spread, ["_end", *keys], name).withColumnRenamed("_end", day)
