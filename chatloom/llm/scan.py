"""Vectorised views of a batch of texts: bytes, words, rolling hashes.

A batch of documents is cut into slices of bounded bytes (one document may be
larger than the bound and then stands alone), and every slice is one byte array
in which documents are separated by a line feed, so that no word and no window
crosses from one document to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

# The six ASCII characters that separate words: space, tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps around)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """Order-dependent hash of several 64-bit columns."""
    h = mix(parts[0].astype(np.uint64))
    for p in parts[1:]:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + p.astype(np.uint64))
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Hash to a float in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_RADIX = np.uint64(0x5851F42D4C957F2D)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hash of any byte span of an array in constant time."""

    _cache: tuple[np.ndarray, np.ndarray] = (_powers(_RADIX, 2), _powers(_INVERSE, 2))

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if len(Rolling._cache[0]) < n + 1:
            Rolling._cache = (_powers(_RADIX, n + 1), _powers(_INVERSE, n + 1))
        self._down = Rolling._cache[1]
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * Rolling._cache[0][:n], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _GOLDEN)


class Slice:
    """Some documents of a batch as one byte array."""

    def __init__(self, first: int, texts: list[bytes]) -> None:
        self.first = first  # index of the first document in its batch
        self.texts = texts
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def __len__(self) -> int:
        return len(self.texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word."""
        starts, ends = runs(~SPACE[self.data])
        return starts, ends, self.owner(starts)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Document of every position."""
        return np.searchsorted(self.starts, at, side="right") - 1


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of true values."""
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    change = np.diff(padded)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a missing text is an empty one."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of about ``limit`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    first = 0
    while first < len(sizes):
        last, total = first + 1, int(sizes[first])
        while last < len(sizes) and total + int(sizes[last]) <= limit:
            total += int(sizes[last])
            last += 1
        yield Slice(first, as_bytes(column.slice(first, last - first)))
        first = last


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """List column from the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
