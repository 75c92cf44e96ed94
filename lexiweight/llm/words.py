"""Words of whole texts as numpy arrays, for code that runs inside Spark tasks.

A text reaches a task as Arrow UTF-8 bytes. Words are found and hashed on those bytes, for a block
of texts at once, so the cost per word is that of a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are handled in blocks of about so many bytes (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)


@dataclass
class Block:
    """Consecutive rows of a batch: ``rows`` are their numbers, ``data`` all their bytes."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    if data is None or len(offsets) == 1:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(
    column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES, rows: int = 1 << 14
) -> Iterator[Block]:
    """The texts of a column in blocks of up to ``limit`` bytes and ``rows`` rows; a text that is
    longer is a block of its own."""
    data, offsets = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        part = offsets[first : last + 1]
        yield Block(range(first, last), data[part[0] : part[-1]], part - part[0])
        first = last


@dataclass
class Words:
    """Words of a block: byte ``start`` and ``end``, row ``doc``, number ``at`` within its row."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    count: np.ndarray


def spans(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length in turn."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def split(block: Block, separator: np.ndarray = _SEPARATOR) -> Words:
    """The maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed, return,
    or than those that ``separator`` marks."""
    inside = ~separator[block.data]
    n = len(inside)
    edges = block.offsets[:-1]
    edges = edges[edges < n]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        begins[edges] = inside[edges]
        ends[:-1] &= ~inside[1:]
        inner = edges[edges > 0] - 1
        ends[inner] = inside[inner]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(block.offsets, start, "right") - 1
    count = np.bincount(doc, minlength=len(block.rows)).astype(np.int64)
    return Words(start, end, doc, spans(count), count)


def word_hashes(block: Block, words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    length = words.end - words.start
    if not len(length):
        return np.zeros(0, np.uint64)
    factor = stream(seed + 2, int(length.max())) | np.uint64(1)
    sums = np.empty(len(length), np.uint64)
    # In parts of about BLOCK_BYTES, so that a very long text takes no more memory.
    edges = np.cumsum(length)
    first = 0
    while first < len(length):
        base = edges[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(edges, base + BLOCK_BYTES, "right")))
        own = length[first:last]
        place = spans(own)
        data = block.data[place + np.repeat(words.start[first:last], own)]
        sums[first:last] = np.add.reduceat(_BYTE[data] * factor[place], np.cumsum(own) - own)
        first = last
    with np.errstate(over="ignore"):
        return mix(sums + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of every ``size`` consecutive words, as if the block were one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = stream(seed + 3, 1)[0] | np.uint64(1)
    with np.errstate(over="ignore"):
        total = hashes[:n].copy()
        for i in range(1, size):
            total *= factor
            total += hashes[i : i + n]
        return mix(total)


def whole_windows(words: Words, size: int) -> np.ndarray:
    """Numbers of the words at which a window of ``size`` words of one text starts."""
    n = len(words.doc) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from all values and the number of values in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
