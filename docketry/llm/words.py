"""Words of many texts at once as numpy arrays: positions in the UTF-8 bytes, 64-bit hashes, hashes of windows.

A word is a run of bytes other than space and 0x09 to 0x0D. Sums are modulo 2**64: with b the byte values under a
fixed random table and an odd p, sum(b[i] * p**i) / p**start does not depend on the place of the word, so one
cumulative sum serves all words (and, over word hashes, all windows) of a slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * P)


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inverse = pow(base, -1, 1 << 64)
    up, down = (np.full(n, b, np.uint64) for b in (base, inverse))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    return _powers(int(base), max(16, int(n).bit_length()))


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and where each begins and ends; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first text, end text, bytes, offsets of runs of texts with some megabytes together (or one long text)."""
    raw, at = utf8(texts)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts, byte ends of the words of a slice; and per text the number of its first word (n + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACES[raw]
    begins, ends = np.ones(n, bool), np.ones(n, bool)
    begins[1:] = ~solid[:-1]
    begins[at[:-1][at[:-1] < n]] = True
    ends[:-1] = begins[1:] | ~solid[1:]
    starts, stops = np.flatnonzero(solid & begins), np.flatnonzero(solid & ends) + 1
    up, down = powers(P, n)
    values = byte_values()[LOWER[raw] if lower else raw]
    values *= up[:n]
    values[~solid] = 0
    sums = np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)
    return mix(sums * down[starts] + (stops - starts).astype(np.uint64)), starts, stops, np.searchsorted(starts, at)


def windows(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of so many words, by its first word; runs over the end of a text are in it too."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(Q, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[length:] - total[:n]) * down[:n] + np.uint64(length + (seed << 32)))


def whole(first_word: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n windows lie in one text."""
    out = np.zeros(max(n, 0), bool)
    for a, b in zip(first_word[:-1], first_word[1:], strict=True):
        if b - a >= length:
            out[a : b - length + 1] = True
    return out
