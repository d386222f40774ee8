"""Columns of vectors as matrices of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array, size: int | None = None) -> np.ndarray:
    """Which lists are not null and hold neither nulls nor values that are not finite; with a size, those of it."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    ok = lengths >= 0 if size is None else lengths == size
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), np.maximum(lengths, 0))
    bad = np.bincount(owner, weights=~np.isfinite(values), minlength=len(column)) > 0
    return ok & ~bad


def scaled(column: pa.Array, size: int, factor: int, most: int) -> np.ndarray:
    """floor(factor * value) as integers, a row for each list; the lists are usable and of one size."""
    x = np.floor(pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size) * factor)
    if len(x) and np.abs(x).max() > most:
        raise ArithmeticError(f"a component beyond {most / factor:g}: exact sums would not fit 64 bits")
    return x.astype(np.int64)
