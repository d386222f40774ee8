"""How often hashes occur in all blocks of documents, told to each block for its own hashes.

A block sends each shard of the hash space one row with its distinct hashes packed in order; the shard adds them up
and answers each of those rows with one packed row. Asked and answered in packed form, a hash costs 4 or 8 bytes
(Spark's own row would take 40), and nothing is collected: shards and blocks are both as many as the input asks for.
In no case are there more rows than distinct (block, hash) pairs.

Narrow hashes keep 32 bits besides the shard. Two hashes may then share a name, so a count is never too small and is
too large for about one in a few thousand; as shards grow with the input, that share stays. Wide ones keep 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

REQUEST = "block long, shard int, wide boolean, keys binary, counts binary"
ANSWER = "block long, shard int, wide boolean, found binary"
REQUEST_ARROW = pa.schema(
    [("block", pa.int64()), ("shard", pa.int32()), ("wide", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())]
)
ANSWER_ARROW = pa.schema(
    [("block", pa.int64()), ("shard", pa.int32()), ("wide", pa.bool_()), ("found", pa.binary())]
)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes together and so on, compressed: small numbers cost about a byte or less."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def restored(data: bytes | pa.Buffer, dtype) -> np.ndarray:
    """What ``squeezed`` made bytes of."""
    data = memoryview(data)
    planes = pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).reshape(-1)


def named(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Narrow names: the shard above 32 bits of the hash; their order is by shard."""
    return ((hashes >> np.uint64(32)) % np.uint64(shards) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def by_shard(hashes: np.ndarray, shards: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names or hashes with how often each occurs, ordered by shard and then by value."""
    found, counts = np.unique(hashes if wide else named(hashes, shards), return_counts=True)
    if wide:
        order = np.argsort((found >> np.uint64(32)) % np.uint64(shards), kind="stable")
        found, counts = found[order], counts[order]
    return found, counts


def _cuts(found: np.ndarray, shards: int, wide: bool) -> np.ndarray:
    of = (found >> np.uint64(32)) % np.uint64(shards) if wide else found >> np.uint64(32)
    return np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))


def request(block: int, found: np.ndarray, counts: np.ndarray, shards: int, wide: bool) -> pa.Table:
    """One row for each shard that some of the hashes belong to."""
    at = _cuts(found, shards, wide)
    used = np.flatnonzero(np.diff(at))
    keys = found if wide else found.astype(np.uint32)
    counts = counts.astype(np.uint32)
    return pa.Table.from_arrays(
        [
            pa.array(np.full(len(used), block, np.int64)), pa.array(used.astype(np.int32)), pa.array([wide] * len(used), pa.bool_()),
            pa.array([keys[at[s] : at[s + 1]].tobytes() for s in used], pa.binary()),
            pa.array([squeezed(counts[at[s] : at[s + 1]]) for s in used], pa.binary()),
        ],
        schema=REQUEST_ARROW,
    )


def packed(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for chunk in column.chunks for x in chunk]


def answered(requests: DataFrame, answer: Callable[[np.ndarray, np.ndarray], np.ndarray], distinct: bool = False) -> DataFrame:
    """answer(keys of a request, their counts over all blocks) is what the block gets back, as bytes. With distinct,
    each shard adds a row of block -1: how many of its wide keys have a count over 0, as decimal digits."""

    def tally(t: pa.Table) -> pa.Table:
        wide = t["wide"][0].as_py()
        keys = packed(t["keys"], np.uint64 if wide else np.uint32)
        every = np.concatenate(keys)
        _, place = np.unique(every, return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate([restored(x.as_buffer(), np.uint32) for x in t["counts"]]))
        total = sums[place].astype(np.int64)
        cuts = np.cumsum([0, *map(len, keys)])
        found = [squeezed(answer(k, total[a:b])) for k, a, b in zip(keys, cuts, cuts[1:], strict=False)]
        block, shard = t["block"].to_pylist(), t["shard"].to_pylist()
        if distinct and wide:
            block, shard, found = [*block, -1], [*shard, shard[0]], [*found, b"%d" % (sums > 0).sum()]
        return pa.Table.from_arrays([pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array([wide] * len(block), pa.bool_()), pa.array(found, pa.binary())], schema=ANSWER_ARROW)

    return requests.groupBy("shard", "wide").applyInArrow(tally, ANSWER)


def joined(answers: pa.Table, dtype, wide: bool) -> np.ndarray:
    """A block's answers in the order of its names."""
    rows = answers.filter(pa.compute.equal(answers["wide"], wide)).sort_by("shard")
    parts = [restored(x.as_buffer(), dtype) for x in rows["found"]]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
