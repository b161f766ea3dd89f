"""The trie of rebuilt conversations, from composable fingerprints; no rebuilt text is ever made.

A turn is an affine map over the integers modulo a prime, drawn from the turn's digest. Maps compose,
the order of turns matters, and every map can be undone: the fingerprint of any sequence of turns
is a product, and products of pieces combine without the turns.

1. Turns are ranged by (conversation, turn), so that one long conversation lies in many tasks. Each task
   numbers its turns and stores the product of those before them; segments of a conversation that spans tasks are
   put together from their products (at most one per task).
2. A rebuilt conversation is the head of its base and its own suffix. Its prefix at depth d
   is head(d), or head * inverse(own head) * own(d): one product per segment, one multiplication per turn.
3. Equal (depth, fingerprint) is one node. Every member must refer to stored turns of equal digest and to
   the same parent; digests that occur more than once are checked on role and text. If fingerprints ever clash, others are drawn.
4. A node's least member names it, and each member is the least one on a tail of its path. Subtree
   sums are suffix sums along the paths of what each conversation names, added up by node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartmill.llm.common import col, join_uneven, sized_broadcast, small_batches, text_of, written

#: Conversations up to the next base share its head.
BASE_EVERY = 20
HEAD_TURNS = 4
MODULUS = 2**127 - 1
ATTEMPTS = 5
#: Depths summed in one window; longer paths are summed by blocks first.
BLOCK_DEPTHS = 1024
#: Conversation ids of one end list that are joined to text at once, as a power of two.
END_BLOCK_BITS = 12
BATCH_ROWS = 10_000

WORD = r"[^\x20\x09-\x0D]+"
IDENTITY = (1, 0)

PATHS = "conv_id long, depth long, fp binary, parent binary, digest binary, words long, is_end boolean"


def head_turns(conv_id: int) -> int:
    """How many turns a conversation takes from its base: unsigned CRC-32 of the id in decimals, modulo four."""
    return zlib.crc32(str(conv_id).encode()) % HEAD_TURNS


class Maps:
    """Affine maps x -> a * x + b modulo a prime, as pairs and as 32 bytes."""

    def __init__(self, modulus: int = MODULUS, salt: int = 0):
        self.modulus, self.salt = modulus, salt.to_bytes(8, "big")

    def of(self, digest: bytes) -> tuple[int, int]:
        drawn = hashlib.blake2b(digest, digest_size=32, salt=self.salt).digest()
        return int.from_bytes(drawn[:16], "big") % (self.modulus - 1) + 1, int.from_bytes(drawn[16:], "big") % self.modulus

    def product(self, first: tuple[int, int], then: tuple[int, int]) -> tuple[int, int]:
        return first[0] * then[0] % self.modulus, (first[1] * then[0] + then[1]) % self.modulus

    def inverse(self, one: tuple[int, int]) -> tuple[int, int]:
        a = pow(one[0], -1, self.modulus)
        return a, -one[1] * a % self.modulus

    @staticmethod
    def packed(one: tuple[int, int]) -> bytes:
        return one[0].to_bytes(16, "big") + one[1].to_bytes(16, "big")

    @staticmethod
    def unpacked(raw: bytes) -> tuple[int, int]:
        return int.from_bytes(raw[:16], "big"), int.from_bytes(raw[16:], "big")


def source_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, digest) of every row with a conversation id."""
    turns = conversations.select(
        col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")
    ).filter("conv_id IS NOT NULL")
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return turns.withColumn("digest", F.unhex(F.sha2(content, 256)))


def stored_turns(turns: DataFrame, maps: Maps) -> DataFrame:
    """(conv_id, seg, i, last, digest, before, words): the i-th turn of a conversation in a task, and the product of those before it there."""
    small_batches(turns.sparkSession, BATCH_ROWS)
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long")
    ordered = (
        turns.repartitionByRange("conv_id", "turn", "role", "text")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
        .select("conv_id", "digest", words.alias("words"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId()
        held, conv, i, product = None, None, 0, IDENTITY
        for batch in batches:
            rows = []
            for own, digest, count in zip(*(column.to_pylist() for column in batch.columns)):
                if own != conv:
                    conv, i, product = own, 0, IDENTITY
                if held is not None:
                    rows.append((*held, held[0] != own))
                held = (own, segment, i, digest, maps.packed(product), count)
                product = maps.product(product, maps.of(digest))
                i += 1
            yield _batch(rows, turn_schema)
        if held is not None:
            yield _batch([(*held, True)], turn_schema)

    turn_schema = pa.schema(
        [("conv_id", pa.int64()), ("seg", pa.int32()), ("i", pa.int64()), ("digest", pa.binary()), ("before", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())]
    )
    return ordered.mapInArrow(work, "conv_id long, seg int, i long, digest binary, before binary, words long, last boolean")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_TURN = pa.struct([("digest", pa.binary()), ("words", pa.int64())])
_FRAME = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("base", pa.int64()),
        ("n", pa.int64()),
        ("heads", pa.list_(_TURN)),
        ("own_head", pa.binary()),
        ("segs", pa.list_(pa.struct([("seg", pa.int32()), ("before", pa.int64()), ("product", pa.binary())]))),
    ]
)
FRAMES = (
    "conv_id long, base long, n long, heads array<struct<digest:binary,words:long>>, own_head binary,"
    " segs array<struct<seg:int,before:long,product:binary>>"
)


def frames(stored: DataFrame, maps: Maps) -> DataFrame:
    """One row per conversation: its first turns, the product of its own head, and what lies before each of its segments."""
    parts = (
        stored.filter(F.col("last") | (F.col("i") < HEAD_TURNS - 1))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("seg", "i", "last", "digest", "before", "words"))).alias("parts"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head = head_turns(conv)
                count, before, heads, own_head, segs, seen = 0, IDENTITY, [], IDENTITY, [], None
                for part in listed:
                    if part["seg"] != seen:
                        seen = part["seg"]
                        segs.append({"seg": seen, "before": count, "product": maps.packed(before)})
                    through = maps.product(maps.product(before, maps.unpacked(part["before"])), maps.of(part["digest"]))
                    at = count + part["i"]
                    if at < HEAD_TURNS - 1:
                        heads.append({"digest": part["digest"], "words": part["words"]})
                        own_head = through if at < head else own_head
                    if part["last"]:
                        count, before = count + part["i"] + 1, through
                base = conv - (abs(conv) % BASE_EVERY) * (1 if conv >= 0 else -1)
                rows.append((conv, base, count, heads, maps.packed(own_head), segs))
            yield _batch(rows, _FRAME)

    return parts.mapInArrow(work, FRAMES)


_PLAN = pa.schema(
    [
        ("conv_id", pa.int64()),
        (
            "heads",
            pa.list_(
                pa.struct(
                    [("depth", pa.int64()), ("fp", pa.binary()), ("parent", pa.binary()), ("digest", pa.binary()), ("words", pa.int64()), ("is_end", pa.bool_())]
                )
            ),
        ),
        ("segs", pa.list_(pa.struct([("seg", pa.int32()), ("skip", pa.int64()), ("shift", pa.int64()), ("end", pa.int64()), ("product", pa.binary())]))),
    ]
)
PLANS = (
    "conv_id long, heads array<struct<depth:long,fp:binary,parent:binary,digest:binary,words:long,is_end:boolean>>,"
    " segs array<struct<seg:int,skip:long,shift:long,end:long,product:binary>>"
)


def plans(framed: DataFrame, maps: Maps) -> DataFrame:
    """Per conversation its nodes down to the base's head, and per segment the product that stands before its own turns."""
    bases = framed.filter(F.col("conv_id") == F.col("base")).select("base", F.col("heads").alias("base_heads"))
    joined = framed.join(bases, "base", "left").select("conv_id", "n", "base_heads", "own_head", "segs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, n, base_heads, own_head, segs in zip(*(column.to_pylist() for column in batch.columns)):
                head = head_turns(conv)
                taken = (base_heads or [])[:head]
                product = IDENTITY
                listed = [(0, maps.packed(IDENTITY), None, None, 0, not taken and n <= head)]
                for depth, turn in enumerate(taken, 1):
                    above, product = product, maps.product(product, maps.of(turn["digest"]))
                    end = depth == len(taken) and n <= head
                    listed.append((depth, maps.packed(product), maps.packed(above), turn["digest"], turn["words"], end))
                start = maps.product(product, maps.inverse(maps.unpacked(own_head)))
                names = ("depth", "fp", "parent", "digest", "words", "is_end")
                own = [
                    {
                        "seg": seg["seg"],
                        "skip": head - seg["before"],
                        "shift": seg["before"] - head + len(taken) + 1,
                        "end": n - 1 - seg["before"],
                        "product": maps.packed(maps.product(start, maps.unpacked(seg["product"]))),
                    }
                    for seg in (segs if n > head else [])
                ]
                rows.append((conv, [dict(zip(names, one)) for one in listed], own))
            yield _batch(rows, _PLAN)

    return joined.mapInArrow(work, PLANS)


_PATH = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int64()), ("fp", pa.binary()), ("parent", pa.binary()), ("digest", pa.binary()), ("words", pa.int64()), ("is_end", pa.bool_())]
)


def paths(stored: DataFrame, planned: DataFrame, maps: Maps) -> DataFrame:
    """One row per rebuilt conversation and depth, with fingerprints of the prefix and of its parent, and the last turn's digest."""
    heads = planned.select("conv_id", F.inline("heads"))
    segs = planned.select("conv_id", F.inline("segs"))
    own = stored.join(segs, ["conv_id", "seg"]).filter("i >= skip")
    own = own.select("conv_id", (F.col("i") + F.col("shift")).alias("depth"), "product", "before", "digest", "words", (F.col("i") == F.col("end")).alias("is_end"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, parent = [], []
            for product, before, digest in zip(*(batch.column(name).to_pylist() for name in ("product", "before", "digest"))):
                above = maps.product(maps.unpacked(product), maps.unpacked(before))
                parent.append(maps.packed(above))
                fp.append(maps.packed(maps.product(above, maps.of(digest))))
            columns = [pa.array(fp, pa.binary()), pa.array(parent, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("depth"), *columns, *(batch.column(n) for n in ("digest", "words", "is_end"))], names=_PATH.names
            )

    return heads.unionByName(own.mapInArrow(work, PATHS))


def nodes_of(walked: DataFrame) -> DataFrame:
    """(depth, fp, parent, conv_id, n_convs, words, differ): one row per node; ``differ`` tells that its members are not equal."""
    return (
        walked.groupBy("depth", "fp")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.max("words").alias("words"),
            *[bound(name).alias(f"{bound.__name__}_{name}") for name in ("parent", "digest") for bound in (F.min, F.max)],
        )
        .select(
            "depth", "fp", F.col("min_parent").alias("parent"), "conv_id", "n_convs", "words",
            (~(F.col("min_parent").eqNullSafe(F.col("max_parent")) & F.col("min_digest").eqNullSafe(F.col("max_digest")))).alias("differ"),
        )
    )


def subtree_sums(walked: DataFrame, weights: DataFrame, names: list[str]) -> DataFrame:
    """(depth, fp, *names): each node's sums of ``weights`` (conv_id, depth, *names), given at the least member, over its subtree.

    Suffix sums run within blocks of depths; what follows a block is summed over whole blocks.
    """
    spread = walked.select("conv_id", "depth", "fp", F.floor(F.col("depth") / BLOCK_DEPTHS).alias("block"))
    spread = spread.join(weights, ["conv_id", "depth"], "left").fillna(0, names)
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = spread.groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in names])
    later = later.select("conv_id", "block", *[F.sum(n).over(after).alias(f"later_{n}") for n in names]).dropna(subset=[f"later_{names[0]}"])
    running = spread.select("conv_id", "block", "depth", "fp", *[F.sum(n).over(inside).alias(n) for n in names]).join(later, ["conv_id", "block"], "left")
    return running.groupBy("depth", "fp").agg(*[F.sum(F.col(n) + F.coalesce(f"later_{n}", F.lit(0))).alias(n) for n in names])


def end_digests(walked: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256): digest of the ascending, comma-joined ids that end at a node; streamed in blocks of ids."""
    small_batches(walked.sparkSession)
    blocks = (
        walked.filter("is_end")
        .groupBy("depth", "fp", F.shiftright("conv_id", END_BLOCK_BITS).alias("block"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
        .repartition("depth", "fp")
        .sortWithinPartitions("depth", "fp", "block")
        .select("depth", "fp", "ids")
    )
    schema = pa.schema([("depth", pa.int64()), ("fp", pa.binary()), ("ends_sha256", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            rows = []
            for depth, fp, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if (depth, fp) != node:
                    if node is not None:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = (depth, fp), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _batch(rows, schema)
        if node is not None:
            yield _batch([(*node, digest.hexdigest())], schema)

    return blocks.mapInArrow(work, "depth long, fp binary, ends_sha256 string")


def equal_digests_are_equal_turns(turns: DataFrame, stored: DataFrame) -> bool:
    """Whether all turns that share a digest have one role and text; only digests that occur again are read with their texts."""
    repeated = written(stored.groupBy("digest").count().filter("count > 1").select("digest"), "repeated")
    texts = turns.join(sized_broadcast(repeated), "digest", "left_semi")
    bounds = texts.groupBy("digest").agg(*[f(name).alias(f"{f.__name__}_{name}") for f in (F.min, F.max) for name in ("role", "text")])
    return bounds.filter("min_role <> max_role OR min_text <> max_text").isEmpty()


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", modulus: int = MODULUS
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Turns are ordered by turn (NULL first), ties by role and then text; repeated rows are turns of
    their own. NULL role or text counts as empty. Rows without a conversation id
    belong to no conversation and are left out. A conversation c is rebuilt as the first h turns of
    conversation c - c % 20 (as many as it has, none if it is absent) and its own turns after its first h. Nodes are
    the distinct prefixes, from the root of depth 0; conv_id is the least conversation that starts with it. An
    empty table gives no rows. Other columns are not read.
    """
    turns = source_turns(conversations, conv_col, turn_col, role_col, text_col)
    for salt in range(ATTEMPTS):
        maps = Maps(modulus if salt == 0 else MODULUS, salt)
        stored = written(stored_turns(turns, maps), "turns")
        if salt == 0 and not equal_digests_are_equal_turns(turns, stored):
            raise ValueError("two turns share a SHA-256 digest")
        planned = written(plans(written(frames(stored, maps), "frames"), maps), "plans")
        walked = written(paths(stored, planned, maps), "paths")
        nodes = written(nodes_of(walked), "nodes")
        if nodes.filter("differ").isEmpty():
            break
    else:
        raise ValueError("fingerprints of different prefixes clash")

    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("fp")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(below, ["depth", "fp"], "left").fillna(0, ["n_children"]), "nodes")
    weights = nodes.select(
        "conv_id", "depth", F.expr("CASE WHEN n_children = 0 THEN 1L ELSE 0L END").alias("n_leaves"), F.expr("(n_convs - 1) * words").alias("saved_tokens")
    )
    sums = subtree_sums(walked, weights, ["n_leaves", "saved_tokens"])
    full = nodes.join(sums, ["depth", "fp"]).join(end_digests(walked), ["depth", "fp"], "left")
    full = full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    tops = nodes.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    named = join_uneven(full.filter("depth > 0"), tops.withColumnRenamed("n_children", "siblings"), ["depth", "parent"], "siblings")
    root = full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return named.select(*columns).unionByName(root.select(*columns))
