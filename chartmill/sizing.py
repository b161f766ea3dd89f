"""How big is the input of a plan?  Decides between a lean plan and a scale-out one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from chartmill.session import ensure_checkpoint_dir

SMALL_INPUT_CONF = "spark.chartmill.smallInputBytes"
SMALL_INPUT_BYTES = 32 * 1024 * 1024
UNKNOWN_BYTES = 2**63 - 1


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: the larger of the plan's own and its leaves' total.

    Scans report file sizes, filters count as free and joins as products, so the
    figure does not fall below what is read from storage. Exploded arrays are
    the exception: their number is unknown, and so is the size.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if _has_generator(plan):
        return UNKNOWN_BYTES
    leaves = plan.collectLeaves()
    scanned = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(scanned, int(str(plan.stats().sizeInBytes())))


def _has_generator(plan) -> bool:
    """True when a plan explodes arrays or maps; told by its nodes, not by names that columns may have as well."""
    if plan.getClass().getSimpleName() == "Generate":
        return True
    children = plan.children()
    return any(_has_generator(children.apply(i)) for i in range(children.size()))


def is_small(df: DataFrame, large: bool | None = None) -> bool:
    """True when all distinct values of the input would fit one task.

    ``large`` answers in place of the estimate, for callers that know or want a certain plan.
    """
    if large is not None:
        return not large
    bound = int(df.sparkSession.conf.get(SMALL_INPUT_CONF, str(SMALL_INPUT_BYTES)))
    return input_bytes(df) <= bound


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Used for aggregated, hence small, results that several later steps must see
    with exactly the same content, and that must outlive lost executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
