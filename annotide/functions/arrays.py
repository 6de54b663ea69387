"""Numpy helpers of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and each text's length."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, lengths


def rolling_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` code points, by its start; equal runs have equal hashes."""
    return next(rolling_widths(points, (width,)))


def rolling_widths(points: np.ndarray, widths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """``rolling_hashes`` for each width, from the same sums."""
    n = len(points)
    with np.errstate(over="ignore"):
        power = np.full(n, BASE, dtype=np.uint64)
        np.cumprod(power, out=power)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        back = np.full(n, _INVERSE, dtype=np.uint64)
        np.cumprod(back, out=back)
        for width in widths:
            yield mix((sums[width:] - sums[: n - width + 1]) * back[: n - width + 1]) if 0 < width <= n else np.empty(0, dtype=np.uint64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values; runs that reach beyond the end cover what is left."""
    least, step = values.copy(), 1
    while step * 2 <= width:
        least[:-step] = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    if rest and len(least) > rest:
        least[:-rest] = np.minimum(least[:-rest], least[rest:])
    return least


def slices(batch: pa.RecordBatch, weights: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose weights sum to about ``limit``, at least one row each."""
    if not batch.num_rows:
        return
    parts = np.cumsum(weights) // max(1, limit)
    starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, end - start)
