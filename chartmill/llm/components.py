"""Connected components of a link table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import written


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of links and an order-free checksum: equal for equal link sets."""
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
    )


def _joined_to_least(pairs: DataFrame, keep) -> DataFrame:
    """Link the neighbours of each node (itself included) to the least of them; ``keep`` picks which ones."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = pairs.join(least, "a").filter(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.filter("a <> m").select("a", F.col("m").alias("b"))
    return linked.union(own).filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (a, b); component is the least node reachable.

    Alternates two contractions until nothing changes: the larger neighbours of
    every node move to its least neighbour, then the smaller ones do. Hubs are
    reduced to their minimum before the shuffle. Each round's links are written
    to the shared folder, so no lineage grows and no lost executor costs more
    than its own tasks. Loops (a = b) carry nothing; an empty table gives no rows.
    """
    edges = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", within=edges
    )
    before = _fingerprint(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _joined_to_least(both, F.col("b") > F.col("a"))
        edges = written(_joined_to_least(large, F.lit(True)), "links", within=edges)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
