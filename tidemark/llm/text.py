"""Vectorised word splitting and word hashing over Arrow string columns.

A batch of texts stays one UTF-8 byte buffer: words are byte ranges of it, and a word's 64-bit hash is taken
eight bytes at a time for all words at once. Python never sees a word unless an operator asks for its bytes.
A null text counts as empty: it has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its rows' offsets, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """data: the bytes (lower-cased if asked for); start, end: byte ranges; rows: first word of each row, and the count."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same on every machine."""
        padded = np.concatenate([self.data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        size = self.end - self.start
        h = mix((eight[self.start] & _MASK[np.minimum(size, 8)]) * _K + size.astype(np.uint64))
        left, k = np.flatnonzero(size > 8), 8
        while len(left):
            more = eight[self.start[left] + k] & _MASK[np.minimum(size[left] - k, 8)]
            h[left] = mix((h[left] ^ more) * _K + np.uint64(k))
            k += 8
            left = left[size[left] > k]
        return h


def split(column: pa.Array | pa.ChunkedArray, kind: np.ndarray, lower: bool = True) -> Words:
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    inside = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def grams(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one row, and the position of each run's first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for j in range(k):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    keep = np.flatnonzero(row[: len(g)] == row[k - 1 :])
    return mix(g[keep] + np.uint64(k)), keep


def sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the values of each row's words."""
    total = np.concatenate([[0], np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    return total[rows[1:]] - total[rows[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a code point of UTF-8."""
    return ((data & 0xC0) != 0x80).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str | tuple[str, str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that a slice has at most `most` bytes of text, or one row.

    column: the texts' name, or the names of a struct column and of the texts in it.
    """
    for batch in batches:
        offsets = buffers(batch.column(column) if isinstance(column, str) else pc.struct_field(batch.column(column[0]), column[1]))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
