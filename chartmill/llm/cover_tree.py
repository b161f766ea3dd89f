"""Exact top-k search by inner product: cover trees over queries and data, searched together.

1. A bounded sample of the vectors gives the upper levels of a cover tree: centres
   chosen farthest first, so that they are apart and every sampled vector is near one.
   Each vector goes to its nearest centre; a node keeps its number of vectors and its covering radius.
2. The sample also answers every query: its k-th best score there is a first
   lower bound. A query goes only to the nodes whose vectors could reach it:
   <q, x> <= <q, c> + |q| * radius.
3. Nodes are cut into blocks of bounded size, and so are the queries; one task searches a block of
   queries against a block of data: a cover tree over each, and a pair of tree nodes is
   descended into only if some vector under one could beat the worst k-th score under the
   other: <cq, cx> + rq * |cx| + rx * |cq| + rq * rx. Leaves are compared by a matrix product.
4. The best k of each block pair are ranked per query.

Bounds only leave out what cannot be among the best k, so the result is exact. The sample
decides how much is left out, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmill.llm.common import col, small_batches, written

SCALE = 256
#: Vectors sampled for centres and first bounds; collected to the driver and broadcast.
SAMPLE = 2048
CENTRES = 64
DATA_BLOCK = 8192
QUERY_BLOCK = 2048
LEAF = 128
CHILDREN = 16
#: A level that cannot shrink its radius to this share with ``CHILDREN`` centres is not worth having.
SHRINK = 0.8
#: Rows of vectors handed to a Python worker at once.
BATCH_VECTORS = 4096


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): each component as floor(scale * x), x as double.

    Left out are vectors that are NULL or hold a NULL or a component that is not finite, those
    without an id, and those of another length than the most frequent one (the longer, if two are).
    """
    component = F.col("x")
    whole = vectors.select(
        col(id_col).cast("long").alias("vec_id"), col(vector_col).cast("array<double>").alias("x")
    ).filter(
        F.col("vec_id").isNotNull()
        & component.isNotNull()
        & F.forall(component, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    )
    lengths = whole.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if lengths is not None:
        whole = whole.filter(F.size("x") == lengths["length"])
    return whole.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("x"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Rows of a list column, or of a binary one that holds doubles."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(rows, -1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def farthest_first(points: np.ndarray, count: int, enough: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres far from one another: their places, each point's centre, each point's distance to it.

    Stops at ``count`` centres or when all points are within ``enough``.
    """
    chosen = [int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))]
    distance = np.sqrt(((points - points[chosen[0]]) ** 2).sum(1))
    owner = np.zeros(len(points), np.int64)
    while len(chosen) < count and distance.max() > enough:
        chosen.append(int(distance.argmax()))
        there = np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1))
        closer = there < distance
        owner[closer] = len(chosen) - 1
        distance[closer] = there[closer]
    return np.array(chosen), owner, distance


class Node:
    """A cover-tree node: rows under it, centre, covering radius, and children unless it is a leaf."""

    __slots__ = ("rows", "centre", "length", "radius", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        own = points[rows]
        self.rows = rows
        self.centre = own[int(np.argmin(((own - own.mean(0)) ** 2).sum(1)))]
        self.length = float(np.sqrt((self.centre**2).sum()))
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(1).max()))
        self.children: list[Node] = []
        if len(rows) <= LEAF or self.radius == 0:
            return
        _, owner, distance = farthest_first(own, CHILDREN, self.radius / 2)
        if distance.max() <= SHRINK * self.radius:
            groups = [rows[owner == child] for child in range(int(owner.max()) + 1)]
            self.children = [Node(points, group) for group in groups if len(group)]


class Search:
    """The best ``k`` of a block of data for each query of a block; ``floor`` are known lower bounds of the k-th scores."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.query_ids, self.worst, self.k = queries, query_ids, floor.copy(), k
        self.data, self.ids = data, ids
        self.best: dict[int, list[tuple[float, int]]] = {}

    def run(self) -> Iterator[tuple[int, int, int]]:
        if len(self.queries) and len(self.data):
            self.descend(Node(self.queries, np.arange(len(self.queries))), Node(self.data, np.arange(len(self.data))))
        for row, found in self.best.items():
            for negative, vec_id in found:
                yield int(self.query_ids[row]), vec_id, int(-negative)

    def reach(self, q: Node, x: Node) -> float:
        """No score under the two nodes is larger; a little is added for rounding."""
        bound = float(q.centre @ x.centre) + q.radius * x.length + x.radius * q.length + q.radius * x.radius
        return bound + 1e-6 * abs(bound) + 1e-3

    def descend(self, q: Node, x: Node) -> None:
        if self.reach(q, x) < self.worst[q.rows].min():
            return
        if not q.children and not x.children:
            self.compare(q.rows, x.rows)
        elif q.children and (not x.children or q.radius > x.radius):
            for child in q.children:
                self.descend(child, x)
        else:
            for child in sorted(x.children, key=lambda child: -self.reach(q, child)):
                self.descend(q, child)

    def compare(self, rows: np.ndarray, columns: np.ndarray) -> None:
        scores = self.queries[rows] @ self.data[columns].T
        scores[self.query_ids[rows][:, None] == self.ids[columns][None, :]] = -np.inf
        if len(columns) > self.k:  # at most k of this leaf pair can count, and ties with the k-th
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
        else:
            kth = np.full(len(rows), -np.inf)
        at, place = np.nonzero((scores >= np.maximum(kth, self.worst[rows])[:, None]) & (scores > -np.inf))
        order = np.lexsort((self.ids[columns[place]], -scores[at, place], at))
        at, place = at[order], place[order]
        cuts = np.flatnonzero(np.diff(at, prepend=-1))
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            row = int(rows[at[begin]])
            found = zip((-scores[at[begin], place[begin:end]]).tolist(), self.ids[columns[place[begin:end]]].tolist())
            merged = sorted({*self.best.get(row, ()), *found})[: self.k]
            self.best[row] = merged
            if len(merged) == self.k:
                self.worst[row] = max(self.worst[row], -merged[-1][0])


def top_k(
    vectors: DataFrame,
    is_query: str = "vec_id % 50 = 0",
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products among all other vectors.

    ``is_query`` is a SQL condition on vec_id. Rank counts from 1; equal scores rank the smaller
    vec_id first; a query with fewer candidates has fewer rows. See ``integer_vectors`` for what takes no part. Rows
    that repeat an id and its vector count once, and a query is no candidate of its own. Scores are exact below 2^53.
    Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, BATCH_VECTORS)
    whole = integer_vectors(vectors, id_col, vector_col, scale)
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    result = "query_id long, rank int, vec_id long, score long"
    if not sample.num_rows:
        return spark.createDataFrame([], result)
    seeds = _matrix(sample.column("x").combine_chunks(), sample.num_rows)
    seed_ids = sample.column("vec_id").to_numpy()
    chosen, _, _ = farthest_first(seeds, CENTRES)
    top = spark.sparkContext.broadcast((seeds[chosen], seeds, seed_ids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = top.value[0]
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1), len(batch))
                distance = ((x**2).sum(1)[:, None] - 2 * x @ centres.T) + (centres**2).sum(1)
                node = distance.argmin(1)
                exact = np.sqrt(((x - centres[node]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), batch.column(0), pa.array([row.tobytes() for row in x], pa.binary()), pa.array(exact)],
                    names=["node", "vec_id", "x", "distance"],
                )

    placed = written(whole.mapInArrow(place, "node long, vec_id long, x binary, distance double"), "placed")
    nodes = {row["node"]: row for row in placed.groupBy("node").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    blocks = {node: -(-row["n"] // DATA_BLOCK) for node, row in nodes.items()}
    queries = placed.filter(is_query)
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to the nodes that its k-th score among the sample does not rule out."""
        centres, others, other_ids = top.value
        known = np.array(sorted(nodes))
        radius = np.array([nodes[node]["radius"] for node in known])
        for batch in batches:
            if not len(batch):
                continue
            x, ids = _matrix(batch.column(2), len(batch)), batch.column(1).to_numpy()
            scores = x @ others.T
            scores[ids[:, None] == other_ids[None, :]] = -np.inf
            first = np.unique(other_ids, return_index=True)[1]  # an id that was sampled twice is one candidate
            scores = scores[:, first]
            floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] >= k else np.full(len(x), -np.inf)
            reach = x @ centres[known].T + np.sqrt((x**2).sum(1))[:, None] * radius
            at, place = np.nonzero(reach + 1e-6 * np.abs(reach) + 1e-3 >= floor[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(known[place]), pa.array(ids[at]), batch.column(2).take(pa.array(at)), pa.array(floor[at])],
                names=["node", "vec_id", "x", "floor"],
            )

    def block_of(count: Column) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(1)), count).cast("long")

    sizes = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    own = placed.select(
        "node",
        block_of(sizes[F.col("node")]).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("queries"),
        "vec_id",
        "x",
    )
    asked = queries.mapInArrow(route, "node long, vec_id long, x binary, floor double").select(
        "node",
        F.explode(F.sequence(F.lit(0).cast("long"), (sizes[F.col("node")] - 1).cast("long"))).alias("block"),
        block_of(F.lit(query_blocks)).alias("queries"),
        "vec_id",
        "x",
        "floor",
    )
    keys = ["node", "block", "queries"]

    def search(asked_rows: pa.Table, rows: pa.Table) -> pa.Table:
        found: list = []
        if asked_rows.num_rows and rows.num_rows:
            asked_rows, rows = asked_rows.combine_chunks(), rows.combine_chunks()
            queries_x, data_x = (_matrix(t.column("x").combine_chunks(), t.num_rows) for t in (asked_rows, rows))
            ids = [t.column("vec_id").to_numpy() for t in (asked_rows, rows)]
            found = list(Search(queries_x, ids[0], asked_rows.column("floor").to_numpy(), data_x, ids[1], k).run())
        columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(3)]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    best = (
        asked.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long").distinct()
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
