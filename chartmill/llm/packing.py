"""Sum-of-squares packing of documents into training sequences of fixed length.

Documents stream through a task once. Whole windows are cut off first; the rest
of a document goes to the open window for which the sum, over all fill levels,
of the squared number of windows at that level becomes smallest. The counts live
in one array indexed by fill level, so a placement is a few vector operations.

Tasks pack what they read, without a shuffle: a source with a third of all rows
is in as many tasks as its files have splits. A task holds the ids of its open
windows only; when these exceed ``MAX_OPEN``, and at the end, open windows are
completed with tokens cut from the emptiest ones. The one window left is cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import col, small_batches, text_of
from chartmill.llm.tokens import default_vocabulary, token_ids

LENGTH = 2048
END_ID = 1
#: Open windows a task keeps; more are completed from one another. Bounds memory, not the result's quality.
MAX_OPEN = 4096

_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class _Piece:
    __slots__ = ("doc_id", "start", "doc_tokens", "ids")

    def __init__(self, doc_id: int | None, start: int, doc_tokens: int, ids: np.ndarray):
        self.doc_id, self.start, self.doc_tokens, self.ids = doc_id, start, doc_tokens, ids

    def cut(self, at: int) -> tuple["_Piece", "_Piece"]:
        left = _Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:at])
        return left, _Piece(self.doc_id, self.start + at, self.doc_tokens, self.ids[at:])


class LevelPacker:
    """The windows of one task. ``rows`` collects the placed pieces of closed windows."""

    def __init__(self, length: int = LENGTH, first_id: int = 0, max_open: int = MAX_OPEN):
        self.length, self.next_id, self.max_open = length, first_id, max_open
        # twice the number of open windows per fill level; a full window costs nothing, which -1 at the end expresses
        self.twice = np.zeros(length + 1, np.int64)
        self.twice[length] = -1
        self.windows: list[list[list[_Piece]]] = [[] for _ in range(length)]
        self.open = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[_Piece]) -> None:
        offset = 0
        for piece in pieces:
            size = len(piece.ids)
            self.rows.append(
                (piece.doc_id, piece.start, size, piece.doc_tokens, self.next_id, offset, piece.ids.astype("<u4").tobytes())
            )
            offset += size
        self.next_id += 1

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) that keeps the sum of squares smallest; the fullest among equals."""
        levels = self.twice[1 : self.length - size + 1]
        change = np.where(levels > 0, self.twice[1 + size :] - levels + 2, np.iinfo(np.int64).max)
        if len(change):
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= self.twice[size] + 1:
                return best + 1
        return 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        piece = _Piece(doc_id, 0, len(ids), ids)
        while len(piece.ids) >= self.length:
            whole, piece = piece.cut(self.length)
            self.close([whole])
        size = len(piece.ids)
        if not size:
            return
        level = self.level_for(size)
        if level:
            window = self.windows[level].pop()
            self.twice[level] -= 2
            self.open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.length:
            self.close(window)
            return
        self.windows[level + size].append(window)
        self.twice[level + size] += 2
        self.open += 1
        if self.open > self.max_open:
            self.complete()

    def complete(self) -> list[_Piece]:
        """Close all open windows but one, filling each with the ends of the emptiest; keep the last one open."""
        left = [(level, window) for level in range(self.length - 1, 0, -1) for window in self.windows[level]]
        self.windows = [[] for _ in range(self.length)]
        self.twice[: self.length] = 0
        self.open = 0
        low = len(left) - 1
        for high, (level, window) in enumerate(left):
            while level < self.length and low > high:
                fill, donor = left[low]
                piece = donor.pop()
                gap = self.length - level
                if len(piece.ids) > gap:
                    rest, piece = piece.cut(len(piece.ids) - gap)
                    donor.append(rest)
                window.append(piece)
                level += len(piece.ids)
                left[low] = (fill - len(piece.ids), donor)
                if not donor:
                    low -= 1
            if level < self.length:
                self.windows[level].append(window)
                self.twice[level] += 2
                self.open = 1
                return window
            self.close(window)
            if low <= high:
                break
        return []

    def finish(self) -> None:
        """Close everything; the last window becomes sequences of power-of-two lengths."""
        pieces = list(self.complete())
        self.windows = [[] for _ in range(self.length)]
        self.twice[: self.length] = 0
        self.open = 0
        rest = sum(len(piece.ids) for piece in pieces)
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            taken = []
            while room:
                piece = pieces.pop(0)
                if len(piece.ids) > room:
                    piece, later = piece.cut(room)
                    pieces.insert(0, later)
                taken.append(piece)
                room -= len(piece.ids)
            self.close(taken)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """Tokenise and pack all documents: one row per piece, with its ids (little-endian unsigned 32-bit).

    A document is its token ids followed by ``end_id``; NULL text is an empty
    document and so a piece of one id. Every id lies in exactly one piece. Within a
    sequence, offsets run from 0 without gaps; sequences other than those of a
    power-of-two length are to be padded to ``length``. Repeated rows are packed
    each, NULL ids are kept, other columns are not read; an empty table gives no rows.
    Sequence ids are unique: the task's number in the upper bits, a counter in the lower.
    """
    small_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = LevelPacker(length, TaskContext.get().partitionId() << 36, max_open)

        def done() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays(
                [pa.array(values, kind.type) for values, kind in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc_id, np.append(token_ids(text, vocabulary), np.uint32(end_id)))
            if packer.rows:
                yield done()
        packer.finish()
        if packer.rows:
            yield done()

    return docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(work, SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
