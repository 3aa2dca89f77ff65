"""Text columns as numpy code-point arrays.

Arrow stores text as one UTF-8 buffer. A batch is decoded in one call, and from then on an
operator works on one flat ``uint32`` array and the offset of each row, without a Python call
per row or character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points from here on do not occur in text; tables are indexed up to it.
TOP = 0x110000


def decode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows and the offsets of each row; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(raw):
        return points, ends - ends[0]
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return points, before[ends - ends[0]]


def encode(points: np.ndarray, offsets: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """The inverse of decode; rows where missing is true become null."""
    points = np.ascontiguousarray(points, dtype=np.uint32)
    data = points.tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=before[1:])
    ends = before[np.asarray(offsets)]
    valid = None if missing is None or not missing.any() else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    if ends[-1] < 2**31:
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [valid, pa.py_buffer(ends), pa.py_buffer(data)])


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def table(*ranges: tuple[int, int] | int | str, dtype=bool) -> np.ndarray:
    """A lookup table over the code points, true in the given ranges (ends included), points and characters."""
    out = np.zeros(TOP, dtype)
    for r in ranges:
        if isinstance(r, str):
            out[[ord(c) for c in r]] = 1
        elif isinstance(r, int):
            out[r] = 1
        else:
            out[r[0] : r[1] + 1] = 1
    return out


def spaces() -> np.ndarray:
    """White space as ``str.isspace`` has it."""
    return table(*(c for c in range(0x3001) if chr(c).isspace()))


#: Coarse scripts: 0 other, 1 Han, 2 kana, 3 Hangul, 4 Latin, 5 Cyrillic, 6 Greek, 7 Devanagari, 8 Thai, 9 digit, 10 space, 11 ASCII sign, 12 wide sign, 13 Arabic.
SCRIPTS = ((0x4E00, 0x9FFF, 1), (0x3400, 0x4DBF, 1), (0x20000, 0x3FFFF, 1), (0xF900, 0xFAFF, 1), (0x2E80, 0x2FDF, 1), (0x3005, 0x3007, 1), (0x3041, 0x30FF, 2), (0x31F0, 0x31FF, 2), (0xFF66, 0xFF9F, 2), (0xAC00, 0xD7A3, 3), (0x1100, 0x11FF, 3), (0xC0, 0x24F, 4), (0x1E00, 0x1EFF, 4), (0x400, 0x52F, 5), (0x370, 0x3FF, 6), (0x1F00, 0x1FFF, 6), (0x900, 0x97F, 7), (0xE01, 0xE5B, 8), (0x600, 0x6FF, 13), (0x3000, 0x3003, 12), (0x3008, 0x3020, 12), (0xFF01, 0xFF0F, 12), (0xFF1A, 0xFF20, 12), (0x21, 0x2F, 11), (0x3A, 0x40, 11), (0x5B, 0x60, 11), (0x7B, 0x7E, 11))


def scripts() -> np.ndarray:
    out = np.zeros(TOP, np.uint8)
    for a, b, k in SCRIPTS:
        out[a : b + 1] = k
    for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)):
        out[a : b + 1] = 4
    for a in (0x30, 0xFF10, 0x966, 0xE50, 0x660):
        out[a : a + 10] = 9
    out[spaces()] = 10
    return out


def sliced(batches: Iterator[pa.RecordBatch], text: str | Callable[[pa.RecordBatch], int], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text holds about ``most`` bytes (a single longer row stays whole), so that memory is bounded however long the texts are."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if callable(text):
            rows = max(1, int(batch.num_rows * most / max(1, text(batch))))
            yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // most
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(cut, [*cut[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


class Hashes:
    """Hashes of any stretch of a code-point array in constant time each, equal for equal stretches in any batch."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, points: np.ndarray):
        n = len(points) + 1
        up = np.full(n, self.BASE, np.uint64)
        up[0] = 1
        down = np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64)
        down[0] = 1
        self.down = np.cumprod(down)
        self.sum = np.zeros(n, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(0x1F3D)) * np.cumprod(up)[:-1], out=self.sum[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Before mixing: that of two stretches together is ``raw(a) + raw(b) * BASE ** length(a)``, modulo 2^64."""
        return (self.sum[end] - self.sum[start]) * self.down[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits."""
    h = np.asarray(h, np.uint64).copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h
