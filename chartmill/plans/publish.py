"""A batch published as a whole: readers see the results of one run or of the one before, never a mixture.

Every run writes to a folder of its own. What makes it the published one is a manifest, written under
another name and renamed over the old one when all charts are done. A run that dies before that
changes nothing for readers.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chartmill.plans.batch import Batch, Written, write_batch
from chartmill.sources.sinks import delete_table, file_exists, replace_file

MANIFEST = "manifest.json"


def manifest(spark: SparkSession, out: str) -> dict[str, Any] | None:
    """The manifest of the published run: run, previous, charts and failed; None before the first one."""
    path = f"{out}/{MANIFEST}"
    if not file_exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def publish_batch(batch: Batch, out: str, fmt: str = "parquet", parallel: int = 4, allow_failed: bool = True) -> list[Written]:
    """Write all charts to a fresh folder under ``out``, then make that run the published one.

    Charts that fail are named in the manifest with their reason; with ``allow_failed`` false, or when no chart
    worked, nothing is published and the outcomes say why. The run before stays for readers that have begun with it; the
    one before that is removed. Runs that died leave a folder no manifest names. One publisher at a time
    writes to ``out``; where renames are not atomic (object stores), a reader may have to try again.
    """
    spark = batch.spark
    before = manifest(spark, out)
    run = f"run-{uuid.uuid4().hex}"
    outcomes = write_batch(batch, f"{out}/{run}", fmt, parallel)
    good = [outcome for outcome in outcomes if outcome.ok]
    if not good or (len(good) < len(outcomes) and not allow_failed):
        delete_table(spark, f"{out}/{run}")
        return [outcome if not outcome.ok else Written(outcome.name, error="not published") for outcome in outcomes]
    charts = {
        outcome.name: {
            "path": f"{run}/{outcome.name}",
            "format": fmt,
            "rows": outcome.rows,
            "schema": batch.datasets[outcome.name].schema.jsonValue(),
        }
        for outcome in good
    }
    text = {
        "run": run,
        "previous": before["run"] if before else None,
        "charts": charts,
        "failed": {outcome.name: outcome.error for outcome in outcomes if not outcome.ok},
    }
    replace_file(spark, f"{out}/{MANIFEST}", json.dumps(text))
    if before and before["previous"]:
        delete_table(spark, f"{out}/{before['previous']}")
    return outcomes


def read_published(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The charts of the published run by name, all of the same run."""
    published = manifest(spark, out)
    if published is None:
        raise FileNotFoundError(f"nothing is published in {out}")
    datasets = {}
    for name, chart in published["charts"].items():
        reader = spark.read.schema(T.StructType.fromJson(chart["schema"]))
        if chart["format"] == "csv":
            reader = reader.options(header=True, escape='"')
        datasets[name] = reader.format(chart["format"]).load(f"{out}/{chart['path']}")
    return datasets
