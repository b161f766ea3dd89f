"""Words and shingles of many texts at once, as 64-bit hashes, with numpy.

Words are runs of characters other than space and U+0009 to U+000D; in UTF-8
those are single bytes that occur nowhere inside other characters, so the scan
works on the bytes of a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Split a batch of texts: number of the first text, bytes, offsets of the texts in them."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        at, to = offsets[first], offsets[last]
        yield first, raw[at:to], offsets[first : last + 1] - at
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of other bytes than ``separators`` (a flag per byte value); texts end runs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = separators[data]
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    inner = offsets[1:-1]
    edge = inner[(inner > 0) & (inner < len(data))]
    begins[edge] = ~space[edge]  # a text begins: so does its first word
    ends[edge - 1] = ~space[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and where each text's words begin among them (one entry more)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start, stop = spans(data, offsets)
    return span_hashes(_LOWER[data] if lower else data, start, stop), np.searchsorted(start, offsets).astype(np.int64)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words, in order."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for place in range(size):
        total = total * _U(0xD6E8FEB86659FD93) + words[place : place + count]
    return mix(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes: windows of ``size`` words, or the whole of fewer words."""
    words, at = word_hashes(data, offsets)
    every = windows(words, size)
    sets = []
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
        if end - begin >= size:
            sets.append(np.unique(every[begin : end - size + 1]))
        elif end > begin:  # salted with the number of words: never equal to a longer window
            short = windows(words[begin:end], end - begin) + _U(end - begin)
            sets.append(mix(short))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
