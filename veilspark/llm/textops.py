"""Vectorised text scanning on Arrow buffers: words, shapes and hashes without a Python object a word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_INV = pow(_ODD, -1, 1 << 64)
SLAB = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space: 0x20, 0x09 to 0x0D
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The class of each byte: lower letters and bytes of longer characters, capitals, digits; other bytes are themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 97
SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(29))


_TABLE = mix(np.arange(1, 257, dtype=U) * U(_ODD))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    size = max(SLAB, 1 << max(0, n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size + 1, _ODD, U), np.full(size + 1, _INV, U)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _powers.clear()
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the range stands."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLE[data] * up[: len(data)], out=run[1:])
        return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U))


class Slab:
    """Some documents' bytes in one array: ``first`` is their number in the batch, ``offsets`` their bounds."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def words(self, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of non-space bytes, and the document of each; none spans two documents."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~SPACE[self.data]
        begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.data))]
        cut = cut[inside[cut + 1] & inside[cut]]
        begin[cut] = True
        end[cut - 1] = True
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        if lower:
            self.data = LOWER[self.data]
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def slabs(texts: pa.Array, limit: int = SLAB) -> Iterator[Slab]:
    """The batch's texts (null: empty) in slabs of about ``limit`` bytes; a longer text is a slab of its own."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    arr = pa.compute.fill_null(arr.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(arr.buffers()[2] or b"", np.uint8) if len(arr) else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield Slab(i, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def release() -> None:
    """Give memory that a task no longer uses back to the system, so that idle workers of an executor hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def append(batch: pa.RecordBatch, schema: pa.Schema | None = None, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *cols.values()], names=[*batch.schema.names, *cols])
