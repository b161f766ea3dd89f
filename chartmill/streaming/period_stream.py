"""Period series over files that are read piece by piece or keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartmill.columns import named
from chartmill.functions.grains import period_start
from chartmill.operators.aggregates import AGGREGATES, check_aggregate
from chartmill.sources.sinks import delete_table, folder_names, write_dataset


def open_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 100
) -> DataFrame:
    """A folder or glob as a stream of at most ``files_per_batch`` files at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


def stream_period_series(
    events: DataFrame, ts: str, value: str, grain: str = "week", group: str | None = None, agg: str = "sum"
) -> DataFrame:
    """``period_series`` for a stream, unordered.

    The state holds one row per period and series, so it is as small as the
    chart and needs no watermark.
    """
    check_aggregate(agg)
    if agg == "median":
        raise ValueError("a median needs all values of a group and cannot be kept up to date on a stream")
    keys = [period_start(named(ts), grain).alias("x")]
    if group is not None:
        keys.append(named(group).alias("series"))
    y = F.coalesce(AGGREGATES[agg](named(value)).cast("double"), F.lit(0.0))
    return events.groupBy(*keys).agg(y.alias("y"))


PREFIX = "batch-"
#: Results left in place: the latest, and the one before for readers that have begun with it.
KEPT = 2


def _published(spark: SparkSession, out: str) -> list[str]:
    """The folders of whole results, oldest first; Spark marks a folder when all its files are in place."""
    return [name for name in folder_names(spark, out) if name.startswith(PREFIX) and "_SUCCESS" in folder_names(spark, f"{out}/{name}")]


def read_latest(spark: SparkSession, out: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """The last whole result that ``write_available`` has published."""
    published = _published(spark, out)
    if not published:
        raise FileNotFoundError(f"no result in {out} yet")
    return spark.read.schema(schema).format(fmt).load(f"{out}/{published[-1]}")


def write_available(result: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Work through everything that is available, batch by batch, then stop.

    Every batch writes the complete result to a fresh folder under ``out``, so readers always find a whole
    one (``read_latest``) and a crash leaves the one before; then all but the last two are removed. A restart
    with the same ``checkpoint`` goes on where the last run ended.
    """

    def publish(batch: DataFrame, number: int) -> None:
        write_dataset(batch, f"{out}/{PREFIX}{number:012d}", fmt)
        for name in _published(batch.sparkSession, out)[:-KEPT]:
            delete_table(batch.sparkSession, f"{out}/{name}")

    query = (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(publish)
        .start()
    )
    query.awaitTermination()
