"""Streams by event time: late events correct what was counted, and a restart goes on where the last run ended.

Batches bring changes only. Each is merged into the result before it and published as a fresh folder,
so the work of a batch grows with what it changed and with the chart, not with all that was ever read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chartmill.columns import join_on, named, require_numeric, type_of
from chartmill.functions.grains import check_grain, period_start, periods_between
from chartmill.sources.sinks import delete_table, write_dataset
from chartmill.streaming.period_stream import KEPT, PREFIX, _published, read_latest

DAY_SCHEMA = "day DATE, {series}n LONG, total DOUBLE, lowest DOUBLE, highest DOUBLE"
COHORT_SCHEMA = "cohort DATE, period DATE, users LONG"
DAY_AGGREGATES = ("sum", "mean", "count", "min", "max")

_DAY_MICROS = 86_400_000_000

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def write_changes(changes: DataFrame, out: str, checkpoint: str, schema: str, merge: Merge, fmt: str = "parquet") -> None:
    """Work through everything available; merge every batch's changes into the result before it.

    ``merge(before, changes)`` gives the new result. A batch that runs again after a crash starts
    from the folder of an earlier batch, so its changes count once. The last two results are kept.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{PREFIX}{number:012d}"
        earlier = [folder for folder in _published(spark, out) if folder < name]
        if earlier:
            before = spark.read.schema(schema).format(fmt).load(f"{out}/{earlier[-1]}")
        else:
            before = spark.createDataFrame([], schema)
        write_dataset(merge(before, batch), f"{out}/{name}", fmt)
        for folder in [*earlier, name][:-KEPT]:
            delete_table(spark, f"{out}/{folder}")

    query = (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )
    query.awaitTermination()


# ------------------------------------------------------------------ series of days


def day_changes(events: DataFrame, ts: str, value: str, late: str, group: str | None = None) -> DataFrame:
    """day, [series,] n, total, lowest, highest of the days that new events touch.

    Days are those of the session's time zone, as in ``period_series``. The state of a day is given up once events ``late``
    after its end have been seen; events for such days are dropped, and Spark counts them in the query's
    progress. Events without a time are left out, values that are NULL are skipped.
    """
    require_numeric(events, value)
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    wall = F.timestamp_diff("MICROSECOND", epoch, named(ts).cast("timestamp_ntz"))
    timed = events.filter(named(ts).isNotNull()).withColumn("_ts", F.timestamp_micros(wall)).withWatermark("_ts", late)
    keys = [F.window("_ts", "1 day").alias("_day")]
    if group is not None:
        keys.append(named(group).alias("series"))
    y = named(value).cast("double")
    cells = timed.groupBy(*keys).agg(
        F.count(y).alias("n"), F.sum(y).alias("total"), F.min(y).alias("lowest"), F.max(y).alias("highest")
    )
    day = F.date_from_unix_date(F.floor(F.unix_micros("_day.start") / _DAY_MICROS).cast("int")).alias("day")
    return cells.select(day, *cells.columns[1:])


def _replaced(before: DataFrame, changes: DataFrame) -> DataFrame:
    """The cells of ``before``, with those that changed in place of their old selves."""
    keys = [name for name in ("day", "series") if name in before.columns]
    marked = changes.select(*keys, F.lit(True).alias("_new"))
    kept = join_on(before, marked, keys, "left").filter("_new IS NULL").drop("_new")
    return kept.unionByName(changes)


def write_days(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Keep the table of days in ``out`` up to date with ``day_changes``."""
    write_changes(changes, out, checkpoint, _day_schema(changes), _replaced)


def _day_schema(changes: DataFrame) -> str:
    series = f"series {type_of(changes, 'series').simpleString()}, " if "series" in changes.columns else ""
    return DAY_SCHEMA.format(series=series)


def read_days(days: DataFrame, grain: str = "week", agg: str = "sum") -> DataFrame:
    """x, [series,] y from a table of days, for any grain and any of sum, mean, count, min and max; 0 without a value."""
    if agg not in DAY_AGGREGATES:
        raise ValueError(f"days keep {', '.join(DAY_AGGREGATES)}, not '{agg}'")
    figures = {
        "sum": F.sum("total"),
        "mean": F.try_divide(F.sum("total"), F.sum("n")),
        "count": F.sum("n"),
        "min": F.min("lowest"),
        "max": F.max("highest"),
    }
    keys = [period_start(F.col("day"), grain).alias("x"), *[name for name in ("series",) if name in days.columns]]
    return days.groupBy(*keys).agg(F.coalesce(figures[agg].cast("double"), F.lit(0.0)).alias("y"))


# ------------------------------------------------------------------ cohorts

_PAIRS = "user {user}, period INT"
_CHANGES = "cohort INT, period INT, users INT"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per user and period of every Arrow batch: a busy user sends few rows to its state."""
    for batch in batches:
        if batch.num_rows:
            pairs = pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([])
            yield from pairs.select(batch.schema.names).to_batches()


def _moves(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a user's new periods change: with an earlier first period, all of its cells move to another cohort."""
    known = set(state.get[0]) if state.exists else set()
    seen = known.union(*[set(frame["period"].tolist()) for frame in frames])
    if seen == known:
        return
    state.update((sorted(seen),))
    rows = [(min(seen), period, 1) for period in seen]
    if known:
        if min(known) == min(seen):
            rows = [row for row in rows if row[1] not in known]
        else:
            rows += [(min(known), period, -1) for period in known]
    yield pd.DataFrame(rows, columns=["cohort", "period", "users"]).astype("int32")


def cohort_changes(events: DataFrame, user: str, ts: str, grain: str = "week") -> DataFrame:
    """cohort, period, users: what new events add to and take from the cells of the cohort table.

    The state of a user is the set of its periods, so an event however late moves the user to the
    cohort of its true first period, and there is no watermark. The state grows with users and with the calendar, not with
    events. Rows without a user or a time are left out.
    """
    check_grain(grain)
    pairs = events.select(
        named(user).alias("user"), F.unix_date(period_start(named(ts), grain)).alias("period")
    ).filter("user IS NOT NULL AND period IS NOT NULL")
    kind: T.DataType = type_of(events, user)
    few = pairs.mapInArrow(_distinct, _PAIRS.format(user=kind.simpleString()))
    return few.groupBy("user").applyInPandasWithState(
        _moves, _CHANGES, "periods array<int>", "update", GroupStateTimeout.NoTimeout
    )


def _added(before: DataFrame, changes: DataFrame) -> DataFrame:
    moved = changes.select(
        F.date_from_unix_date("cohort").alias("cohort"), F.date_from_unix_date("period").alias("period"), F.col("users").cast("long")
    )
    return before.unionByName(moved).groupBy("cohort", "period").agg(F.sum("users").alias("users")).filter("users <> 0")


def write_cohorts(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Keep the cohort cells in ``out`` up to date with ``cohort_changes``."""
    write_changes(changes, out, checkpoint, COHORT_SCHEMA, _added)


def read_cohorts(spark, out: str, grain: str = "week") -> DataFrame:
    """cohort, period_number, users, as ``cohorts`` gives them for all events read so far."""
    cells = read_latest(spark, out, COHORT_SCHEMA)
    return cells.select("cohort", periods_between(F.col("cohort"), F.col("period"), grain).alias("period_number"), "users")
