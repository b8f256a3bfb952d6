"""Vectorised word hashing over Arrow string columns (numpy, inside tasks).

Words are maximal runs of bytes outside space and \\x09-\\x0D, so they equal
``[^\\x20\\x09-\\x0D]+`` on the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_rng = np.random.default_rng(20240131)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
for _t in _BYTES:
    _t[_WS] = 0
_BASE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_WORD_BASE = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n at least; kept for the process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of the batch whose texts hold about ``limit`` bytes (one row at least)."""
    offsets = text_buffers(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) else pa.large_binary())
    _, offs, data = col.buffers()
    if offs is None or not len(col):
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Word bounds and 64-bit word hashes of all rows of a string column."""

    def __init__(self, col: pa.Array, lower: bool = False, hashes: int = 1):
        raw, self.offsets = text_buffers(col)
        if lower:
            raw = _LOWER[raw]
        self.raw = raw
        gap = _WS[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[self.offsets] = True
        inside = ~gap
        before = np.concatenate([[True], gap[:-1]]) if len(raw) else gap
        self.starts = np.flatnonzero(inside & (before | first[:-1]))
        #: index of the first word of each row, and one past the last
        self.rows = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.rows)
        self.hashes = [self._hash(raw, k) for k in range(hashes)]

    def _hash(self, raw: np.ndarray, k: int) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        s = self.starts[0]
        lengths = np.diff(np.append(self.starts, len(raw)))
        place = np.arange(s, len(raw), dtype=np.int64) - np.repeat(self.starts, lengths)
        value = _BYTES[k][raw[s:]] * powers(int(_BASE[k]), int(lengths.max()))[place]
        return mix(np.add.reduceat(value, self.starts - s))

    def rolling(self, width: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each window inside one row, its hash), windows of ``width`` words."""
        h, base = self.hashes[k], _WORD_BASE[k]
        n = len(h)
        if n < width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(base, n)[:n], dtype=np.uint64)])
        left = np.repeat(self.rows[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(left >= width)
        inverse = powers(pow(base, -1, 1 << 64), n)
        return at, mix((total[at + width] - total[at]) * inverse[at])


def distinct(h: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values of each segment in turn, their number); segment k ends before stops[k]."""
    out, start = [], 0
    for stop in stops.tolist():
        part = np.sort(h[start:stop])
        if len(part) > 1:
            part = part[np.append(True, part[1:] != part[:-1])]
        out.append(part)
        start = stop
    return (np.concatenate(out) if out else h[:0]), np.array([len(x) for x in out], np.int64)
