"""Arrow batches cut into pieces of bounded size, for work on whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401


def pieces(batches, text: str = "text", most: int = 1 << 20):
    """Slices of the batches with at most about `most` bytes of text each, and one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes + 16), 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts in an ordered array, and its length."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    return start, np.diff(start, append=len(ordered))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random odd number for each byte, from a rule.
_BYTE = ((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) ^ np.uint64(0x5851F42D4C957F2D)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(2 * n, b, np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Spans:
    """64-bit hashes of any spans of bytes, from prefix sums: equal bytes, equal hash, wherever they are."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mixed(_BYTE)[data] * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def split(data: np.ndarray, separates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in an array of bytes; separates: a table of 256."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separates[data]
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def joined(texts: list[bytes], between: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by a separator, and where each begins (with the end of all)."""
    data = np.frombuffer(between.join([*texts, b""]), np.uint8)
    return data, np.concatenate([[0], np.cumsum(np.array([len(t) + len(between) for t in texts], np.int64))]) if texts else np.zeros(1, np.int64)
