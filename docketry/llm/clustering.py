"""k-means over whole numbers with heap-ordered bounds.

Each block of vectors keeps a heap per cluster. A heap holds the gaps between the second nearest and the nearest
centroid, measured when a vector was last scanned, plus the drift its cluster had accumulated by then. Centroids that
move add to the drift; a vector whose gap it has used up is popped and scanned again, exactly. All others keep their
cluster unseen. Blocks are rows: a round maps them and sums what moved, nothing is shuffled but sums.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import scaled, usable

#: Vectors of one block; components beyond MOST would overflow sums of squares.
BLOCK, MOST = 4096, 1 << 27
#: What rounding may add to a bound, relative to the distances.
SLACK = 1e-9

STATE = "ids array<long>, x binary, cluster binary, keys binary, rows binary, sums array<long>, scanned long"


@dataclass
class Clusters:
    """``rows``: vec_id, cluster, distance of each vector; final centroids; vectors scanned in each round."""

    rows: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the smaller number on ties), its squared distance, that of the second nearest; exact."""
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if x.shape[1] * 4 * int(largest) ** 2 < 1 << 53 else np.int64
    a, c = x.astype(kind), centroids.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    rows, best = np.arange(len(x)), d.argmin(1)
    first = d[rows, best].copy()
    d[rows, best] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
    return best, first.astype(np.int64), d.min(1).astype(np.float64)


class _Block:
    """Vectors, the cluster of each, and for each cluster a heap of (gap + drift when scanned, row)."""

    def __init__(self, ids, x: np.ndarray, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.ids, self.x, self.cluster, self.heaps = ids, x, cluster, heaps

    @classmethod
    def new(cls, ids, x: np.ndarray, k: int) -> _Block:
        return cls(ids, x, np.full(len(x), -1, np.int32), [[] for _ in range(k)])

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, k: int) -> _Block:
        ids = batch["ids"][i].values
        cluster = np.frombuffer(batch["cluster"][i].as_py(), np.int32).copy()
        x = np.frombuffer(batch["x"][i].as_py(), np.int32).reshape(len(ids), -1).astype(np.int64)
        keys, rows = np.frombuffer(batch["keys"][i].as_py(), np.float64), np.frombuffer(batch["rows"][i].as_py(), np.int32)
        cuts = np.cumsum(np.bincount(cluster, minlength=k))[:-1]
        return cls(ids, x, cluster, [list(zip(a.tolist(), b.tolist(), strict=True)) for a, b in zip(np.split(keys, cuts), np.split(rows, cuts), strict=True)])

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pops the rows whose gap their cluster's drift has used up."""
        out = []
        for heap, used in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= used:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def scan(self, rows: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Assigns rows anew; returns by how much the count and the sums of each cluster change (k x (1 + size))."""
        k, change = len(centroids), np.zeros((len(centroids), 1 + self.x.shape[1]), np.int64)
        if not len(rows):
            return change
        best, first, second = _nearest(self.x[rows], centroids)
        near, far = np.sqrt(first.astype(np.float64)), np.sqrt(second)
        gap = np.where(np.isinf(far), np.inf, (far - near) - SLACK * (1 + np.where(np.isinf(far), 0, far) + near))
        for key, row, c in zip((gap + drift[best]).tolist(), rows.tolist(), best.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (key, row))
        old, moved = self.cluster[rows], best != self.cluster[rows]
        one = np.hstack([np.ones((len(rows), 1), np.int64), self.x[rows]])
        np.add.at(change, best[moved], one[moved])
        left = moved & (old >= 0)
        np.subtract.at(change, old[left], one[left])
        self.cluster[rows] = best
        return change

    def written(self, change: np.ndarray, scanned: int) -> list:
        keys = np.array([key for heap in self.heaps for key, _ in heap], np.float64)
        rows = np.array([row for heap in self.heaps for _, row in heap], np.int32)
        return [
            self.ids, self.x.astype(np.int32).tobytes(), self.cluster.astype(np.int32).tobytes(), keys.tobytes(), rows.tobytes(),
            change.ravel().tolist() if change.any() else [], scanned,
        ]


def _state(block: _Block, change: np.ndarray, scanned: int) -> pa.RecordBatch:
    ids, *rest = block.written(change, scanned)
    one = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    types = (pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64())
    return pa.RecordBatch.from_arrays([one, *(pa.array([v], t) for v, t in zip(rest, types, strict=True))], names=[c.split()[0] for c in STATE.split(", ")])


def _changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, int]:
    """Sum over all blocks of what moved (k x (1 + size)), and of the vectors scanned: summed in the partitions first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scanned = np.zeros(k * (1 + size), np.int64), 0
        for batch in batches:
            scanned += sum(batch["scanned"].to_pylist())
            for row in batch["sums"]:
                if len(row):
                    total += row.values.to_numpy()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], scanned))], names=["place", "n"])

    # k * (1 + size) numbers at most
    out, scanned = np.zeros(k * (1 + size), np.int64), 0
    for place, n in state.select("sums", "scanned").mapInArrow(add, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        if place < 0:
            scanned = n
        else:
            out[place] = n
    return out.reshape(k, 1 + size), scanned


def _drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much a gap in each cluster may shrink: its centroid's way and the longest way of any other; rounded up."""
    way = np.sqrt(((old - new).astype(np.float64) ** 2).sum(1))
    others = np.array([np.delete(way, c).max(initial=0.0) for c in range(len(way))])
    return (way + others) * (1 + SLACK)


def first_centroids(vectors: DataFrame, k: int, order: Column, size: int, factor: int) -> np.ndarray:
    """The usable vectors that come first by ``order`` (null ids last, ties by the vector), as whole numbers."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(usable(batch["embedding"], size)))
            x = scaled(own["embedding"], size, factor, MOST)
            yield pa.RecordBatch.from_arrays([own["h"], pa.array(x.tolist(), pa.list_(pa.int64()))], names=["h", "x"])

    found = vectors.select(order.alias("h"), "embedding").mapInArrow(pick, "h string, x array<long>")
    # k rows
    return np.array([r["x"] for r in found.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()], np.int64).reshape(-1, size)


def cluster(vectors: DataFrame, k: int, rounds: int, order: Column, size: int = 64, factor: int = 256, block: int = BLOCK) -> Clusters:
    """Lloyd's rounds over vectors (vec_id, embedding) as whole numbers floor(factor * component), then one more assignment.

    Rows count whose embedding has ``size`` components, none null or not finite; the others, and null embeddings, are
    left out. The first k of them by ``order`` are the first centroids, in that order, fewer if there are fewer rows. Each round
    assigns all rows to the nearest centroid (ties: the smaller number) and moves centroids that have rows to the
    floor of their mean. Repeated rows count each; a null vec_id stays and starts no centroid unless ids run out.
    Without rows the result is empty. Components beyond 2 ** 27 / factor raise ArithmeticError. Other columns are
    not looked at.
    """
    centroids = first_centroids(vectors, k, order, size, factor)
    k = len(centroids)
    out = "vec_id long, cluster int, distance long"
    if not k:
        return Clusters(vectors.sparkSession.createDataFrame([], out), centroids, [])

    drift = np.zeros(k)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(usable(batch["embedding"], size)))
            for low in range(0, own.num_rows, block):
                part = own.slice(low, block)
                new = _Block.new(part["vec_id"], scaled(part["embedding"], size, factor, MOST), k)
                yield _state(new, new.scan(np.arange(len(new.x)), centroids, drift), len(new.x))

    state = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(start, STATE))
    sums, scanned = _changes(state, k, size)
    counts = [scanned]
    for _ in range(rounds):
        has = sums[:, :1] > 0
        moved = np.where(has, np.floor_divide(sums[:, 1:], np.maximum(sums[:, :1], 1)), centroids)
        drift, centroids = drift + _drifts(centroids, moved), moved
        state = stored(state.mapInArrow(_round(centroids, drift), STATE))
        change, scanned = _changes(state, k, size)
        sums += change
        counts.append(scanned)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block.read(batch, i, k)
                away = b.x - centroids[b.cluster]
                yield pa.RecordBatch.from_arrays([b.ids, pa.array(b.cluster), pa.array((away * away).sum(1))], names=["vec_id", "cluster", "distance"])

    return Clusters(state.select("ids", "x", "cluster", "keys", "rows").mapInArrow(told, out), centroids, counts)


def _round(centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block.read(batch, i, len(centroids))
                rows = block.expired(drift)
                yield _state(block, block.scan(rows, centroids, drift), len(rows))

    return run
