"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# For clusters. Shuffles start with many partitions, so that none outgrows its
# task, and AQE merges the small ones; splits are large because charts read few
# columns of each file.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.files.maxPartitionBytes": "512MB",
}


def sizing_settings(master: str) -> dict[str, str]:
    """Partition sizes for a master: one shuffle partition per core for a local one."""
    if not master.startswith("local"):
        return dict(CLUSTER_SETTINGS)
    cores = master.partition("[")[2].rstrip("]").split(",")[0]
    return {"spark.sql.shuffle.partitions": cores} if cores.isdigit() else {}


def build_session(app_name: str = "chartmill", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` override them.

    Partition sizes follow from the master the session ends up with, and leave
    alone what spark-submit or the defaults file have set.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in sizing_settings(spark.sparkContext.master).items():
        if key not in settings and not given.contains(key):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, for checkpoints and staged tables.

    It is the session's ``spark.checkpoint.dir``, else the checkpoint folder the
    application has set. Only a local master may run without either; there a
    fresh temporary folder stands in.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="chartmill-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder unless one is set already."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
