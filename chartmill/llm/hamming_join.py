"""Near-duplicate documents by a multi-index Hamming join of b-bit minhash signatures.

1. Every document becomes its set of word shingles; equal sets are one node from here on.
2. A set's signature is a number of minhashes (slots) of 8 bits. At the linking
   similarity a pair differs in a binomial number of slots; the distance lies so far in its tail
   that about one linked pair in 100,000 would differ more. ``LAYOUTS`` has one layout per least similarity.
3. A signature is split into chunks. Two signatures within a distance of
   2 * chunks - 1 differing slots have, by the pigeonhole principle, a chunk
   with at most one differing slot. All such errors are enumerated: a chunk is filed
   once per slot, with that slot left out. So the pair shares a key, always.
4. Nodes that share a key are confirmed on their full sets - not all pairs of
   them, which a group of n copies would have n * n / 2 of. The node of a key that shares keys most often
   is its hub; each node within the distance of a hub is compared with it. Nodes that are not connected to
   their hub by then, if enough of their shingles occur in any other set at all, are compared with all nodes
   of the hub's keys in blocks of bounded size (``set_units``), which give links, not pairs. Every pair
   within the distance is thus linked, or connected anyway, or refuted on its full sets.
5. Connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import col, fresh, join_uneven, sized_broadcast, small_batches, text_of, written
from chartmill.llm.components import connected_components
from chartmill.llm.set_units import compared_with_hubs, mixed_units, star_labels, stray_links
from chartmill.llm.textscan import chunks, mix, shingle_sets

SHINGLE_WORDS = 5
PERCENT = 85


@dataclass(frozen=True)
class Layout:
    """How signatures are cut into chunks; there is room for 256 slots in a key."""

    chunk_slots: int
    chunks: int

    @property
    def slots(self) -> int:
        return self.chunk_slots * self.chunks

    @property
    def distance(self) -> int:
        return 2 * self.chunks - 1


#: By the least percentage: the probability that a pair at it differs in more slots is 5.4e-6 at 85 and 9.9e-6 at 80.
LAYOUTS = {85: Layout(6, 16), 80: Layout(5, 18)}
DEFAULT_LAYOUT = LAYOUTS[PERCENT]
SLOTS = DEFAULT_LAYOUT.slots
DISTANCE = DEFAULT_LAYOUT.distance
#: Node ids broadcast to pick texts for confirmation; beyond it, they are joined.
BROADCAST_IDS = 1_000_000

_MOST_SLOTS = max(layout.slots for layout in LAYOUTS.values())
_FACTORS = np.random.default_rng(7).integers(1, 2**63, _MOST_SLOTS, dtype=np.uint64) | np.uint64(1)
_SALTS = mix(np.arange(1, _MOST_SLOTS + 1, dtype=np.uint64))


def layout_for(percent: int) -> Layout:
    """The layout for links at ``percent`` and more."""
    fitting = [least for least in LAYOUTS if least <= percent]
    if not fitting:
        raise ValueError(f"signatures are laid out for at least {min(LAYOUTS)} percent")
    return LAYOUTS[max(fitting)]


def signatures(sets: list[np.ndarray], layout: Layout = DEFAULT_LAYOUT) -> np.ndarray:
    """One row with a byte per slot for each non-empty set."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), layout.slots), np.uint8)
    work = np.empty_like(flat)
    for slot in range(layout.slots):
        np.multiply(flat, _FACTORS[slot], out=work)
        out[:, slot] = (mix(np.minimum.reduceat(work, begins) ^ _SALTS[slot]) >> np.uint64(56)).astype(np.uint8)
    return out


def document_signatures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout = DEFAULT_LAYOUT
) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of every document; digest and sig are NULL for empty sets."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, SHINGLE_WORDS)
                some = [s for s in sets if len(s)]
                rows = iter(signatures(some, layout) if some else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sig"],
                )

    source = docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(work, "doc_id long, n_shingles long, digest binary, sig binary")


def _matrix(column: pa.Array, layout: Layout) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, layout.slots)


def signature_keys(nodes: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """(key, node): each chunk of a signature, once for every slot left out. Keys are exact, not hashed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = _matrix(batch.column(1), layout).reshape(-1, layout.chunks, layout.chunk_slots).astype(np.int64)
            keys = np.empty((len(parts), layout.chunks, layout.chunk_slots), np.int64)
            for gap in range(layout.chunk_slots):
                packed = np.zeros(parts.shape[:2], np.int64)
                for slot in range(layout.chunk_slots):
                    if slot != gap:
                        packed = (packed << 8) | parts[:, :, slot]
                keys[:, :, gap] = (packed << 8) | (np.arange(layout.chunks) * layout.chunk_slots + gap)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), layout.slots))], names=["key", "node"]
            )

    return nodes.select("node", "sig").mapInArrow(work, "key long, node long")


def within_distance(pairs: DataFrame, nodes: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """The pairs (hub, node) whose signatures lie within the layout's distance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                differ = (_matrix(batch.column(2), layout) != _matrix(batch.column(3), layout)).sum(1)
                yield batch.select(["hub", "node"]).filter(pa.array(differ <= layout.distance))

    hubs = pairs.groupBy("hub").agg(F.count("*").alias("n")).join(nodes.select(F.col("node").alias("hub"), F.col("sig").alias("sig_hub")), "hub")
    joined = join_uneven(pairs.join(nodes.select("node", "sig"), "node"), written(hubs, "hubs", within=nodes), ["hub"], "n")
    return joined.select("hub", "node", "sig_hub", "sig").mapInArrow(work, "hub long, node long")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, size, set): sorted shingle hashes, eight bytes each, of the wanted (node, doc_id, digest); one row per node."""
    source = docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    chosen = source.join(sized_broadcast(wanted.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                raw = [s.tobytes() for s in shingle_sets(data, offsets, SHINGLE_WORDS)]
                digests = pa.array([hashlib.blake2b(one, digest_size=16).digest() for one in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array([len(one) // 8 for one in raw], pa.int64()), pa.array(raw, pa.binary())], names=["digest", "size", "set"])

    found = chosen.mapInArrow(work, "digest binary, size long, set binary").join(wanted.select("node", "digest"), "digest")
    # rows of the table that repeat a document give its set again
    return found.groupBy("node").agg(F.first("size").alias("size"), F.first("set").alias("set"))


def hubs_of_keys(members: DataFrame) -> DataFrame:
    """(hub, node): for each key the node that shares keys most often, with all nodes of the key; each pair once."""
    often = members.groupBy("node").agg(F.count("*").alias("often"))
    hubs = (
        members.join(often, "node")
        .groupBy("key")
        .agg(F.max(F.struct("often", (-F.col("node")).alias("least"))).alias("best"), F.count("*").alias("n"))
        .select("key", (-F.col("best.least")).alias("hub"), "n")
    )
    return join_uneven(members, written(hubs, "keys", within=members), ["key"], "n").select("hub", "node").distinct()


def shared_sizes(sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, shared): a set's size and how many of its shingles any other of these sets has.

    No set can have more than ``shared`` shingles in common with another one. Nodes for which that
    is too few for a link with anything are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                values = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("set")]
                nodes = np.repeat(batch.column("node").to_numpy(), [len(v) for v in values])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(nodes)], names=["shingle", "node"])

    alone = (
        sets.mapInArrow(work, "shingle long, node long")
        .groupBy("shingle")
        .agg(F.min("node").alias("node"), F.max("node").alias("other"))
        .filter("node = other")
        .groupBy("node")
        .agg(F.count("*").alias("alone"))
    )
    return (
        sets.select("node", "size")
        .join(alone, "node", "left")
        .select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))
        .filter(F.col("shared") * 100 >= F.col("size") * percent)
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Words are lower-cased (A-Z) runs of characters other than space and U+0009 to
    U+000D. A document's set holds its distinct windows of five words, or its whole
    word sequence if it has fewer. Two documents are linked if 100 * intersection >=
    percent * union; component_id is the least doc_id reachable over links, and
    the document with that id is kept. Documents without words (NULL or
    empty text) have n_shingles 0, are linked with nothing and kept. A row with a NULL
    id is linked with nothing, has a NULL component_id and is kept. Repeated rows get
    equal results. Other columns are not read; an empty table gives no rows.
    Distance and chunks are those of ``LAYOUTS`` for ``percent``; less than 80 is refused.
    """
    layout = layout_for(percent)
    described = written(document_signatures(docs, id_col, text_col, layout), "signatures")
    ones = described.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    # one node per set, with its least document and a signature that is the same for all of them
    nodes = written(
        ones.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "sig")).alias("first"), F.count("*").alias("n"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.sig").alias("sig"), "n"),
        "nodes",
        within=described,
    )
    keys = signature_keys(nodes, layout)
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    members = written(keys.join(shared.select("key"), "key"), "members")
    units = written(hubs_of_keys(members), "units", within=members)

    near = written(within_distance(units.filter("hub <> node"), nodes, layout), "near")
    wanted = near.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    sets = written(full_sets(docs, _named(nodes, wanted), id_col, text_col), "sets")
    stars = written(compared_with_hubs(near, sets, percent), "stars")
    labels = written(star_labels(stars), "labels", within=stars)
    placed = written(mixed_units(units, labels), "placed", within=units)

    sets = written(full_sets(docs, _named(nodes, placed.select("node").distinct()), id_col, text_col), "sets")
    records = sets.join(written(shared_sizes(sets, percent), "sizes", within=sets).select("node"), "node", "left_semi")
    links = written(stray_links(placed.join(records.select("node"), "node", "left_semi"), records, percent), "links")

    found = connected_components(stars.union(links)).withColumnRenamed("component", "cluster")
    joined = nodes.select("node", "digest", "doc_id", "n").join(found, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    joined = written(joined, "clusters", within=nodes)
    clusters = joined.groupBy("cluster").agg(F.min("doc_id").alias("component"), F.count("*").alias("sets"))
    classes = written(join_uneven(joined, clusters, ["cluster"], "sets").select("digest", "component", "n"), "classes", within=nodes)
    linked = join_uneven(ones.select("doc_id", "n_shingles", "digest"), classes, ["digest"], "n").select("doc_id", "n_shingles", "component")
    rest = described.filter("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return linked.unionByName(rest).select(
        "doc_id",
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def _named(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, doc_id, digest) of the wanted nodes."""
    return written(nodes.select("node", "doc_id", "digest").join(wanted, "node", "left_semi"), "wanted", within=nodes)


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, all columns as they are."""
    found = near_duplicates(docs, id_col, text_col, percent)
    name = fresh("_dropped", docs)
    dropped = written(found.filter("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "dropped", within=docs)
    return docs.join(sized_broadcast(dropped), col(id_col).cast("long") == F.col(name), "left_anti")
