"""Vectors as exact integers: what clustering and search share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LARGEST = (1 << 63) - 1


def integers(column: pa.Array, scale: int, components: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers): floor(scale * x) of the vectors without null or non-finite components that have `components` of them; with
    None, of all lengths, followed by zeros up to the longest. The integers are int64, or Python's where they need more."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == components if components is not None else size >= 0)
    size = size[rows]
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    which = np.repeat(np.arange(len(rows)), size)
    good = np.bincount(which[~np.isfinite(x)], minlength=len(rows)) == 0
    x, rows, size = x[good[which]], rows[good], size[good]
    if np.abs(x).max(initial=0) * scale < 2.0**62:
        whole = np.floor(x * scale).astype(np.int64)
    else:
        whole = np.array([math.floor(v * scale) if abs(v) < 2.0**52 else int(v) * scale for v in x.tolist()], object)
    out = np.zeros((len(rows), components if components is not None else size.max(initial=0)), whole.dtype)
    out[np.arange(out.shape[1]) < size[:, None]] = whole
    return rows, out


def largest(*arrays: np.ndarray) -> int:
    """The greatest absolute value in the arrays."""
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T, exact: in doubles where they hold every sum, else in Python's integers."""
    if largest(x, y) ** 2 * max(1, x.shape[-1]) < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(object) @ y.astype(object).T


def as_long(n: int) -> int:
    return min(max(int(n), -LARGEST - 1), LARGEST)
