"""Words and hashes of whole Arrow text columns, by numpy, without a Python object per word.

A word is a run of bytes other than space and 0x09-0x0D.  A column is taken in slices of about
``SLICE_BYTES`` so that the temporary arrays stay small however many rows a batch has; one document is
never split, so the largest document bounds the memory of a task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

SLICE_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 5  # any odd number of high order modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base (``up``) or of its inverse (``down``) modulo 2**64."""
    have = _powers[kind]
    if len(have) < n:
        base = np.uint64(_BASE if kind == "up" else _BASE_INVERSE)
        grown = np.full(max(n, 2 * len(have)), base, np.uint64)
        grown[0] = 1
        have = _powers[kind] = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums with which ``range_hash`` hashes any range of ``data``."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    up = data.astype(np.uint64)
    up += np.uint64(1)
    up *= _power("up", len(data))
    np.cumsum(up, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal ranges have equal hashes wherever they are."""
    h = (prefix[end] - prefix[start]) * _power("down", len(prefix))[start]
    h ^= mix((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return mix(h)


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to
    released()


def released() -> None:
    """Gives memory that is free in this process back to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a line feed after each, and the rows' offsets in them."""
    ended = pc.binary_join_element_wise(column, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    data = ended.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """The words of some rows: ``data`` has them in order, each followed by one space.

    ``start``/``end``: each word's place in data; ``first``: of each row its first word, then the count of all.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, width: int = 1) -> np.ndarray:
        """Hashes of all runs of ``width`` words, by first word; runs over a row's end are there too."""
        n = len(self.start) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return range_hash(prefix_hash(self.data), self.start[:n], self.end[width - 1 :])


def split_words(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = joined(column)
    if not len(data):
        return Words(data, offsets[:0], offsets[:0], np.zeros(len(column) + 1, np.int64))
    if lower:
        data = LOWER[data]
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]  # the data ends with a space, so each word has an end
    keep = ~space
    keep[end] = True
    data = data[keep]
    length = end - start
    to = np.cumsum(length + 1)
    data[to - 1] = 0x20
    first = np.searchsorted(start, offsets)
    return Words(data, to - length - 1, to - 1, first.astype(np.int64))


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word its row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... start + length - 1 of each range, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    to = np.cumsum(length)
    return np.repeat(start - (to - length), length) + np.arange(total)


def binaries(data: bytes | np.ndarray, length: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive pieces of data."""
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    raw = pa.py_buffer(data if isinstance(data, bytes) else np.ascontiguousarray(data))
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), raw])
