"""Vectorised word handling over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which for UTF-8
text is the same as ``[^\\x20\\x09-\\x0D]+`` over characters. Word hashes come
from one polynomial prefix sum per batch, so no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are handled at once; a dozen arrays of eight bytes each stand for every one of them.
_CHUNK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for positions 0 to n."""
    global _powers, _inverses
    if n < 2 * _CHUNK < len(_powers):  # a very long text is over: give its tables back
        _powers, _inverses = _powers[: 2 * _CHUNK].copy(), _inverses[: 2 * _CHUNK].copy()
    if len(_powers) <= n:
        size = max(n + 1, 2 * _CHUNK if n < 2 * _CHUNK else n + 1)
        grown = []
        for base in (_BASE, _INVERSE):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            grown.append(np.multiply.accumulate(step))
        _powers, _inverses = grown
    return _powers, _inverses


@dataclass
class Words:
    """Words of some consecutive texts: byte spans, text index and hash of each."""

    first: int
    count: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    bounds: np.ndarray
    _sums: np.ndarray

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans (whole words if none are given)."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        _, inverses = _scale(len(self.data))
        return mix((self._sums[ends] - self._sums[starts]) * inverses[starts])

    def rows(self) -> Iterator[tuple[int, int, int]]:
        """(row in the column, first word, end word) of every text."""
        for i in range(self.count):
            yield self.first + i, int(self.bounds[i]), int(self.bounds[i + 1])


def spans(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if at is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Iterator[Words]:
    """Words of a string column, in chunks of about a quarter of a megabyte of text."""
    data, offsets = spans(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1
        end = min(max(end, at + 1), rows)
        yield _split(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at, lower)
        at = end


def _split(data: np.ndarray, offsets: np.ndarray, first: int, lower: bool) -> Words:
    n = len(data)
    if lower:
        data = _LOWER[data]
    space = (data == 32) | ((data - np.uint8(9)) <= 4)
    opens, closes = np.ones(n, bool), np.ones(n, bool)
    opens[1:] = space[:-1]
    closes[:-1] = space[1:]
    opens[offsets[:-1][offsets[:-1] < n]] = True
    closes[offsets[1:][offsets[1:] > 0] - 1] = True
    opens &= ~space
    closes &= ~space
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    powers, _ = _scale(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[:n], out=sums[1:])
    return Words(first, len(offsets) - 1, data, starts, ends, text, np.searchsorted(starts, offsets), sums)
