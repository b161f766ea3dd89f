"""Jaccard join of word n-gram sets with an inverted index that set relations let it skip.

1. Screen. A linked pair shares ``need`` elements among its least hashes (the prefix filter, with a prefix
   longer by as many elements). Sets with fewer elements there that any other set has too can have no link.
2. Order. In how many of the remaining sets an element occurs gives the order of the index: rare elements first,
   those of one set before all others. The first elements of a set are its index entries, each with
   its position: from position i on, a set has no more than size - i elements left to share.
3. Index. A list holds the sets with an element, in blocks of equal (size, position). A block without any other
   in reach of it - by size, and by what both positions leave - is skipped with all its sets. The
   set of a list with the fewest elements of its own is the list's hub.
4. Answers. Every set in a list is compared with the hub. The answers of the sets not connected to it are derived
   from the hub's, by the elements in which they differ from it (``set_units``).
5. Connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import col, join_uneven, sized_broadcast, small_batches, text_of, written
from chartmill.llm.components import connected_components
from chartmill.llm.set_units import compared_with_hubs, mixed_units, star_labels, stray_links
from chartmill.llm.textscan import chunks, shingle_sets

SHINGLE_WORDS = 4
PERCENT = 85
#: The screen's prefix is longer by one in so many elements.
SCREEN_PART = 20
#: Document ids broadcast to pick texts; beyond it, they are joined.
BROADCAST_IDS = 1_000_000


def least_overlap(size, percent: int):
    """The fewest elements a set of this size shares with a similar one: ceil(percent / 100 * size)."""
    return -(-size * percent // 100)


def screen_length(size: int, percent: int) -> tuple[int, int]:
    """How many of a set's least elements the screen files, and how many of them must occur in another set."""
    more = max(1, size // SCREEN_PART)
    # a partner has at least percent / 100 of this size, and so may file fewer
    return min(size, size - least_overlap(size, percent) + more), max(1, least_overlap(size, percent) // SCREEN_PART)


def _node(values: np.ndarray) -> int:
    """A set's name: 64 bits of its digest, which does not depend on a document."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "big", signed=True)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def described(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n_shingles, node, head) of every document: the name of its set, and the set's least elements."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, SHINGLE_WORDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([s[: screen_length(len(s), percent)[0]].tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "node", "head"],
                )

    return docs.mapInArrow(work, "doc_id long, n_shingles long, node long, head binary")


def elements(sets: DataFrame) -> DataFrame:
    """(element, node, size) of every element of the sets (node, size, set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            values = [np.frombuffer(cell.as_buffer(), np.int64) for cell in batch.column("set")]
            counts = [len(v) for v in values]
            columns = [np.repeat(batch.column(name).to_numpy(), counts) for name in ("node", "size")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), *map(pa.array, columns)], names=["element", "node", "size"])

    return sets.select("node", "size", "set").mapInArrow(work, "element long, node long, size long")


def screened(heads: DataFrame, percent: int) -> DataFrame:
    """The nodes that share enough of their least elements with other sets to have a link at all."""
    filed = elements(heads.select("node", F.col("n_shingles").alias("size"), F.col("head").alias("set")))
    shared = filed.groupBy("element").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    shared = written(shared.filter("low <> high").select("element", "n"), "shared")
    least = F.floor((F.col("size") * percent + 99) / 100)
    need = F.greatest(F.lit(1), F.floor(least / SCREEN_PART))
    # copies of a set file the same elements: each copy alone would have to share enough
    found = join_uneven(filed, shared, ["element"], "n").groupBy("node", "size").agg(F.countDistinct("element").alias("shared"))
    return found.filter(F.col("shared") >= need).select("node")


def set_records(sets: DataFrame) -> DataFrame:
    """(node, size, set, order): a set's elements that other sets have too, by value and in the order of the index."""
    counts = elements(sets).groupBy("element").agg(F.count("*").alias("n")).filter("n > 1")
    counts = written(counts, "counts")
    placed = join_uneven(elements(sets), counts, ["element"], "n")
    lists = placed.groupBy("node", "size").agg(F.collect_list(F.struct("n", "element")).alias("parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordered, plain = [], []
            for cell in batch.column("parts"):
                values = cell.values
                n, element = (values.field(name).to_numpy() for name in ("n", "element"))
                element, first = np.unique(element, return_index=True)  # equal rows of the table repeat a set
                ordered.append(element[np.lexsort((element, n[first]))].tobytes())
                plain.append(np.sort(element.view(np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("size"), pa.array(plain, pa.binary()), pa.array(ordered, pa.binary())],
                names=["node", "size", "set", "order"],
            )

    return lists.mapInArrow(work, "node long, size long, set binary, order binary")


def index_entries(records: DataFrame, percent: int) -> DataFrame:
    """(element, node, size, pos, alone): the elements by which a set can be found; ``alone`` is how many it has for itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for node, size, cell in zip(batch.column("node").to_pylist(), batch.column("size").to_pylist(), batch.column("order")):
                values = np.frombuffer(cell.as_buffer(), np.int64)
                alone = size - len(values)
                count = max(0, min(size - least_overlap(size, percent) + 1 - alone, len(values)))
                for column, part in zip(out, (values[:count], node, size, alone + np.arange(count), alone)):
                    column.append(np.broadcast_to(part, count))
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(column).astype(np.int64)) for column in out], names=["element", "node", "size", "pos", "alone"]
                )

    return records.select("node", "size", "order").mapInArrow(work, "element long, node long, size long, pos long, alone long")


def live_blocks(size: np.ndarray, pos: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which blocks (size, position) of a list, sorted so, can hold a set that links with another set of the list.

    Sets of sizes s and t link only if they share percent * (s + t) / (100 + percent), and from positions i and j
    on they share at most min(s - i, t - j). Each size is tried with the least position any block of it has.
    """
    left = size - pos
    begins = np.flatnonzero(np.append(True, size[1:] != size[:-1]))
    sizes, most = size[begins], left[begins]
    alone = np.add.reduceat(n, begins) == 1
    low = np.searchsorted(sizes, -(-size * percent // 100))
    high = np.searchsorted(sizes, size * 100 // percent, "right")
    own = np.searchsorted(sizes, size)
    live = np.zeros(len(size), bool)
    for step in range(int((high - low).max(initial=0))):  # sizes in reach of each block, one by one for all blocks
        todo = np.flatnonzero(~live & (low + step < high))
        other = low[todo] + step
        enough = np.minimum(left[todo], most[other]) * (100 + percent) >= percent * (size[todo] + sizes[other])
        live[todo] = enough & ((other != own[todo]) | ~alone[other])
    return live


def index_lists(entries: DataFrame, percent: int) -> DataFrame:
    """(element, size, pos, n, hub): the blocks of the index that are not skipped, with their list's hub."""
    blocks = (
        entries.groupBy("element", "size", "pos")
        .agg(F.count("*").alias("n"), F.min(F.struct("alone", "node")).alias("best"))
        .select("element", "size", "pos", "n", F.col("best.alone").alias("alone"), F.col("best.node").alias("node"))
        .repartition("element")
        .sortWithinPartitions("element", "size", "pos")
    )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole lists, and as many of them at once as a batch ends."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            element = batch.column("element").to_numpy()
            cut = int(np.searchsorted(element, element[-1])) if (np.diff(element) >= 0).all() else 0
            if held and (cut > 0 or held[-1].column("element")[-1].as_py() != element[0]):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch.slice(0))
        if held:
            yield pa.Table.from_batches(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in listed(batches):
            element, size, pos, n, alone, node = (table.column(i).to_numpy() for i in range(6))
            cuts = [0, *(np.flatnonzero(element[1:] != element[:-1]) + 1).tolist(), len(element)]
            keep, hub = np.zeros(len(element), bool), np.zeros(len(element), np.int64)
            for begin, end in zip(cuts, cuts[1:]):
                if n[begin:end].sum() > 1:
                    live = live_blocks(size[begin:end], pos[begin:end], n[begin:end], percent)
                    keep[begin:end] = live
                    if live.any():
                        at = begin + np.flatnonzero(live)
                        hub[begin:end] = node[at[np.lexsort((node[at], alone[at]))[0]]]
            if keep.any():
                columns = [pa.array(column[keep]) for column in (element, size, pos, n, hub)]
                yield pa.RecordBatch.from_arrays(columns, names=["element", "size", "pos", "n", "hub"])

    return blocks.mapInArrow(work, "element long, size long, pos long, n long, hub long")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    Words are lower-cased (A-Z) runs of characters other than space and U+0009 to U+000D. A
    document's set holds its distinct windows of four words, or its whole word sequence if it has fewer. Two
    documents link if 100 * intersection >= percent * union; component_id is the least doc_id reachable.
    Documents without words (NULL or empty text) have n_shingles 0 and link with nothing, and so do
    rows with a NULL id, whose component_id is NULL. Repeated rows get equal results; rows that share an id and differ in text
    link by their texts. Other columns are not read; an empty table gives no rows.
    """
    source = _documents(docs, id_col, text_col)
    found = written(described(source, percent), "described")
    some = found.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    survivors = written(screened(some, percent), "survivors")
    classes = written(some.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    wanted = written(classes.join(survivors, "node", "left_semi").select(F.col("first").alias("doc_id")).distinct(), "wanted")
    chosen = source.join(sized_broadcast(wanted, BROADCAST_IDS), "doc_id", "left_semi")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                sets = [s for s in shingle_sets(data, offsets, SHINGLE_WORDS) if len(s)]
                columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "size", "set"])

    sets = written(chosen.mapInArrow(whole, "node long, size long, set binary"), "sets")
    records = written(set_records(sets), "records")
    entries = written(index_entries(records, percent), "entries")
    lists = written(index_lists(entries, percent), "lists")
    members = join_uneven(entries.select("element", "size", "pos", "node"), lists, ["element", "size", "pos"], "n")
    members = written(members.select("hub", "node").distinct(), "members")

    records = records.select("node", "size", "set")
    stars = written(compared_with_hubs(members.filter("hub <> node"), records, percent), "stars")
    labels = written(star_labels(stars), "labels")
    placed = mixed_units(members.join(records.select("node"), "node", "left_semi"), labels)
    links = written(stray_links(written(placed, "placed"), records, percent), "links")
    components = connected_components(stars.union(links)).withColumnRenamed("component", "cluster")

    joined = classes.join(components, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    joined = written(joined, "clusters")
    clusters = joined.groupBy("cluster").agg(F.min("first").alias("component_id"), F.count("*").alias("sets"))
    named = join_uneven(joined.select("cluster", "node", "n"), clusters, ["cluster"], "sets").select("node", "n", "component_id")
    named = written(named, "named")
    rest = found.filter("node IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_uneven(some.select("doc_id", "n_shingles", "node"), named, ["node"], "n").select(*rest.columns).unionByName(rest)
