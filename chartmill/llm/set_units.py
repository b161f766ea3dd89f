"""Exact decisions between sets around a common, similar set (the hub), without a row per pair.

A unit is a hub and its members. Every member is compared with the hub. Members that are not
connected to the hub by then (strays) are compared with all members: a member's answers follow from the hub's, by
the few elements in which both differ from it. Units are cut into blocks of strays times blocks of
members; each task holds one block of strays and streams the members past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import join_uneven, small_batches, written

#: Members compared with a hub in one piece of work; strays held at once; members streamed past them.
HUB_MEMBERS = 1024
OWN_STRAYS = 256
OTHER_MEMBERS = 4096

HUB, OWN, OTHER = 0, 1, 2


def _values(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint64)


def _similar(overlap, size_a, size_b, percent: int):
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def numbered_blocks(total: str, size: int):
    return F.ceil(F.col(total) / size).cast("int")


def compared_with_hubs(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the distinct pairs (hub, node) that are similar enough; ``records`` has (node, size, set), sets sorted.

    ``size`` may exceed the elements in ``set`` by such as no other set has.
    """
    small_batches(pairs.sparkSession)
    hubs = written(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hubs", within=pairs)
    blocks = numbered_blocks("n", HUB_MEMBERS)
    placed = join_uneven(pairs, hubs, ["hub"], "n")
    members = placed.select("hub", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.lit(OWN).alias("role"), "node")
    heads = hubs.select("hub", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(HUB).alias("role"), F.col("hub").alias("node"))
    rows = (
        members.union(heads)
        .join(records, "node")
        .select("hub", "block", "role", "node", "size", "set")
        .repartition("hub", "block")
        .sortWithinPartitions("hub", "block", "role")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, center_size = None, 0
        for batch in batches:
            keep = []
            sizes, roles = batch.column("size").to_pylist(), batch.column("role").to_pylist()
            for size, role, cell in zip(sizes, roles, batch.column("set")):
                if role == HUB:
                    center, center_size = _values(cell).copy(), size
                    keep.append(False)
                    continue
                if min(size, center_size) * 100 < percent * max(size, center_size):
                    keep.append(False)
                    continue
                own = _values(cell)
                at = np.searchsorted(center, own)
                shared = int((center[np.minimum(at, len(center) - 1)] == own).sum()) if len(center) else 0
                keep.append(_similar(shared, size, center_size, percent))
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column("hub"), found.column("node")], names=["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


class _Strays:
    """A block of strays, by the elements in which each differs from the hub."""

    def __init__(self, hub: np.ndarray, rows: list[tuple]):
        self.hub = hub
        self.node, self.label, self.size = (np.array([row[i] for row in rows]) for i in range(3))
        self.held = np.array([len(row[3]) for row in rows])
        apart = [np.setxor1d(hub, row[3], assume_unique=True) for row in rows]
        self.differ = np.array([len(one) for one in apart])
        every = np.concatenate(apart)
        order = np.argsort(every, kind="stable")
        self.elements, self.begin = np.unique(every[order], return_index=True)
        self.end = np.append(self.begin[1:], len(every))
        self.owner = np.repeat(np.arange(len(rows)), self.differ)[order]

    def links(self, node: int, label: int, size: int, values: np.ndarray, percent: int) -> np.ndarray:
        """Strays of other labels that are similar to a member, one per label."""
        apart = np.setxor1d(self.hub, values, assume_unique=True)
        at = np.minimum(np.searchsorted(self.elements, apart), max(len(self.elements) - 1, 0))
        at = at[self.elements[at] == apart] if len(self.elements) else at[:0]
        runs = self.end[at] - self.begin[at]
        inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        common = np.bincount(self.owner[np.repeat(self.begin[at], runs) + inside], minlength=len(self.node))
        # |x & y| from |x|, |y| and the symmetric difference of their differences from the hub
        overlap = (self.held + len(values) - (self.differ + len(apart) - 2 * common)) // 2
        found = np.flatnonzero(_similar(overlap, self.size, size, percent) & (self.label != label) & (self.node != node))
        return found[np.unique(self.label[found], return_index=True)[1]]


def mixed_units(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, node, label, stray, n): the members of units whose members are not all connected yet.

    ``members`` has the distinct (hub, node) of all units, hubs among their nodes; ``labels`` (node, label), where
    equal labels mean connected and a missing one stands for the node itself. ``n`` is the size of the unit.
    """
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = written(labelled.select("hub", "node", "label"), "labelled", within=members)
    sizes = labelled.groupBy("hub").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    centers = labels.select(F.col("node").alias("hub"), F.col("label").alias("center"))
    mixed = sizes.filter("low <> high").join(centers, "hub", "left").select("hub", "n", F.coalesce("center", "hub").alias("center"))
    placed = join_uneven(labelled, written(mixed, "mixed", within=members), ["hub"], "n")
    return placed.select("hub", "node", "label", (F.col("label") != F.col("center")).alias("stray"), "n")


def stray_links(placed: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all members of mixed units which are similar enough and not connected yet.

    ``records`` (node, size, set) may leave out members that cannot link with any other.
    Of several links between a stray and one label's nodes that meet in a task, one is returned.
    """
    small_batches(placed.sparkSession)
    strays = placed.groupBy("hub").agg(F.max("n").alias("n"), F.sum(F.col("stray").cast("long")).alias("strays"))
    units = written(
        strays.filter("strays > 0").select(
            "hub", "n", numbered_blocks("strays", OWN_STRAYS).alias("owns"), numbered_blocks("n", OTHER_MEMBERS).alias("others")
        ),
        "units",
        within=placed,
    )
    rows = join_uneven(placed.select("hub", "node", "label", "stray"), units, ["hub"], "n")
    own_block = F.pmod(F.xxhash64("node"), F.col("owns")).cast("int")
    other_block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    own = rows.filter("stray").select("hub", own_block.alias("own"), every("others").alias("other"), F.lit(OWN).alias("role"), "node", "label")
    other = rows.select("hub", every("owns").alias("own"), other_block.alias("other"), F.lit(OTHER).alias("role"), "node", "label")
    heads = units.select("hub", every("owns").alias("own"), "others").select(
        "hub", "own", every("others").alias("other"), F.lit(HUB).alias("role"), F.col("hub").alias("node"), F.col("hub").alias("label")
    )
    work_rows = (
        own.union(other)
        .union(heads)
        .join(records, "node")
        .select("hub", "own", "other", "role", "node", "label", "size", "set")
        .repartition("hub", "own", "other")
        .sortWithinPartitions("hub", "own", "other", "role")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, center, waiting, strays = None, None, [], None
        for batch in batches:
            a, b = [], []
            ids = zip(*(batch.column(name).to_pylist() for name in ("hub", "own", "other", "role", "node", "label", "size")))
            for (hub, own, other, role, node, label, size), cell in zip(ids, batch.column("set")):
                if (hub, own, other) != unit:
                    unit, center, waiting, strays = (hub, own, other), np.zeros(0, np.uint64), [], None
                if role == HUB:
                    center = _values(cell).copy()
                elif role == OWN:
                    waiting.append((node, label, size, _values(cell).copy()))
                elif waiting or strays:
                    if strays is None:
                        strays, waiting = _Strays(center, waiting), []
                    for at in strays.links(node, label, size, _values(cell), percent):
                        a.append(int(min(node, strays.node[at])))
                        b.append(int(max(node, strays.node[at])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work_rows.mapInArrow(work, "a long, b long").distinct()


def star_labels(stars: DataFrame) -> DataFrame:
    """(node, label) from links (a, b): the least node one step away, then that node's, and again; equal labels mean connected."""
    labels = stars.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    for _ in range(2):
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        labels = labels.join(above, "label", "left").select("node", F.coalesce("upper", "label").alias("label"))
    return labels
