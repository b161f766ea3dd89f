"""Helpers the corpus operators share: reading, writing between stages, names, batches."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.session import shared_dir
from chartmill.sizing import input_bytes

#: The folder that holds the package ``chartmill``.
PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])
BATCH_ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows, and bytes, handed to a Python worker at once; whichever is reached first.
BATCH_ROWS = 500
BATCH_BYTES = 8 * 1024 * 1024
#: A side of a join is broadcast only when it was counted and holds no more rows than this.
BROADCAST_ROWS = 100_000
#: A table whose files follow another one's size gets a file for so many bytes of that.
FILE_BYTES = 1024 * 1024
MOST_FILES = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def text_of(name: str) -> Column:
    """A text column in which NULL counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names (in any case) an operator is about to add."""
    taken = {name.lower() for name in names}
    return df.select(*[col(name) for name in df.columns if name.lower() not in taken])


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ready the session for Python tasks: small batches, so that long texts fit in memory, and this package on their path.

    The package's place is handed to the workers as the driver knows it; where executors
    have it elsewhere, ship it with the application (``--py-files``).
    """
    for key, value in ((BATCH_ROWS_CONF, str(rows)), (BATCH_BYTES_CONF, str(BATCH_BYTES))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, known)])


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, within: DataFrame | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    What was written outlives lost executors, is computed once however often it
    is used, and brings its true size to the joins that follow. ``within`` is a table that ``df`` is hardly
    larger than: files, and the tasks that write them, then follow its size at most, not the number of shuffle
    partitions. On a local file system without Hadoop's native library an executor starts a process for each file and checksum.
    """
    if within is not None:
        df = df.coalesce(_files_for(within))
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files_for(df: DataFrame) -> int:
    """As many files as its bytes call for, and one for each core; without limit if the size is unknown."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(input_bytes(df) // FILE_BYTES + 1, MOST_FILES))


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcasting if a count proves it small; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


#: Groups with more than this part of all rows are joined by broadcast: there are fewer of them than this.
HEAVY_GROUPS = 10_000
LIGHT_ROWS = 1_000


def join_uneven(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has each key once and tells in ``weight`` how many of the rows have it.

    Groups of more than total / HEAVY_GROUPS rows are broadcast: their number is below
    HEAVY_GROUPS whatever the size. The others are small enough for one task each.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    bound = max(total // HEAVY_GROUPS, LIGHT_ROWS)
    heavy = groups.filter(F.col(weight) > bound)
    light = groups.filter(F.col(weight) <= bound)
    return rows.join(F.broadcast(heavy), keys).unionByName(
        rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    )
