"""Vectors in Arrow columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def usable(col: str = "embedding"):
    """Not null, no null and no non-finite component."""
    c = F.col(col).cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(col).isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """float64 (rows, dim); shorter vectors are filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = len(lists)
    out = np.zeros((n, dim))
    if not n:
        return out
    off = lists.offsets.to_numpy()
    flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)
    size = np.diff(off)
    if (size == dim).all():
        return flat[off[0] : off[-1]].reshape(n, dim)
    at = np.arange(len(flat[off[0] : off[-1]]))
    row = np.repeat(np.arange(n), size)
    out[row, at - np.repeat(off[:-1] - off[0], size)] = flat[off[0] : off[-1]]
    return out


def raw(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m)
    return pa.array([r.tobytes() for r in m], pa.binary())


def from_raw(col, dim: int, kind="<f8") -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, dim)


def spread(points: np.ndarray, k: int, rounds: int, seed: int = 3) -> np.ndarray:
    """k centres of the points: farthest-first seeds, then Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = [points[rng.integers(len(points))]] if k else []
    far = np.full(len(points), np.inf)
    while len(centres) < k:
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1))
        centres.append(points[int(far.argmax())])
    c = np.array(centres).reshape(k, points.shape[1])
    for _ in range(rounds):
        own = nearest(points, c)[0]
        for j in range(k):
            if (own == j).any():
                c[j] = points[own == j].mean(0)
    return c


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squared(a, c)
    i = d.argmin(1)
    return i, np.sqrt(d[np.arange(len(a)), i])
