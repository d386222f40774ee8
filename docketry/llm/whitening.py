"""Whitening of vectors by principal components, found by spectral divide and conquer.

The covariance is summed in the partitions, over distinct vectors. A polar decomposition of the covariance minus a shift
(QDWH: dynamically weighted Halley steps by QR factors) has the eigenvalues 1 and -1, so half of it plus the identity
projects on the components above the shift. Both subspaces are split again until each is one component. The
components, a matrix of the vectors' size, are sent to all tasks and whiten row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import scaled, usable

#: Whole numbers: floor(SCALE * component) + OFFSET; beyond MOST sums over the rows would overflow.
SCALE, OFFSET, MOST = 64, 1_000_000, 1 << 40
#: Subspaces whose eigenvalues differ by less, relative to the largest, are not split: any basis is one of components.
SAME = 1e-15

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: for each eigenvalue its sign (QDWH)."""
    size = len(a)
    x = a / max(np.linalg.norm(a), 1e-300)
    least, eye = 1e-16, np.eye(size)
    for _ in range(12):
        square = least * least
        d = np.cbrt(4 * (1 - square) / square**2)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * both[:size] @ both[size:].T
        new, before = (new + new.T) / 2, x
        x, least = new, min(least * (p + q * square) / (1 + r * square), 1.0)
        if 1 - least < 1e-15 and np.linalg.norm(x - before) < 1e-12 * np.sqrt(size):
            break
    return x


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces above and below a shift; None if all eigenvalues are the same."""
    size = len(a)
    middle = np.trace(a) / size
    # below the mean and above it there is an eigenvalue each, so the mean splits unless all are equal or one is too near
    spread = np.linalg.norm(a - middle * np.eye(size))
    rng = np.random.default_rng(size)
    for shift in (middle, *(middle + spread / size * t for t in (0.1, -0.1, 0.03, -0.03, 0.3, -0.3, 0.007, -0.007))):
        u = polar(a - shift * np.eye(size))
        projector = (u + np.eye(size)) / 2
        rank = round(float(np.trace(projector)))
        if 0 < rank < size and np.linalg.norm(projector @ projector - projector) < 1e-10 * size:
            # the projector twice, as a random start may be nearly at a right angle to a direction
            first, _ = np.linalg.qr(projector @ rng.normal(size=(size, rank)))
            basis, _ = np.linalg.qr(projector @ first, mode="complete")
            return basis[:, :rank], basis[:, rank:]
    return None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = max(np.linalg.norm(a), 1e-300)

    def split(basis: np.ndarray) -> Iterator[np.ndarray]:
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        size = len(own)
        apart = np.linalg.norm(own - np.trace(own) / size * np.eye(size))
        halves = _halves(own) if size > 1 and apart > SAME * scale else None
        if halves is None:
            yield basis
        else:
            for half in halves:
                yield from split(basis @ half)

    vectors = np.hstack(list(split(np.eye(len(a)))))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(rows: DataFrame, size: int, width: int, terms) -> np.ndarray:
    """Sum over rows of terms(x), an array of ``width`` numbers for each batch: partition sums, then their sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + terms(_matrix(batch["x"], size))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["place", "v"])

    kind = "long" if terms(np.zeros((1, size), np.int64)).dtype == np.int64 else "double"
    out = np.zeros(width, np.int64 if kind == "long" else np.float64)
    # ``width`` rows: at most the square of the vectors' size
    found = rows.select("x").mapInArrow(add, f"place long, v {kind}").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out[np.array(found["place"])] = np.array(found["v"])
    return out


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """OUT: for each usable row of vectors (vec_id, embedding) and each component its whitened value.

    Rows whose embedding is null or empty or holds nulls or values that are not finite are left out. Components are
    fitted to the distinct vectors of whole numbers floor(64 * value) + 1000000, each once; repeated rows are whitened
    each, null ids stay. Vectors of different sizes are fitted apart. Components without variance (fewer distinct
    vectors than components, constant dimensions) give 0 and stay out of identity_error; explained is 0 where nothing
    varies. deviation is null beyond 64 bits. Components of equal variance are any basis of their subspace. Without rows the
    result is empty. Other columns are not looked at.
    """

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(usable(batch["embedding"])))
            x = scaled(own["embedding"], 1, SCALE, MOST)[:, 0] + OFFSET
            cuts = np.cumsum([0, *pc.list_value_length(own["embedding"]).to_pylist()])
            yield pa.RecordBatch.from_arrays([own["vec_id"], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x))], names=["vec_id", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(numbers, "vec_id long, x array<long>").where("size(x) > 0")
    fit_list = stored(rows.select("x").distinct().withColumn("size", F.size("x")))
    sizes = sorted((r["size"], r["count"]) for r in fit_list.groupBy("size").count().collect())
    out = vectors.sparkSession.createDataFrame([], OUT)
    for size, n in sizes:
        out = out.union(_whitened(rows, fit_list.where(F.col("size") == size), size, n, components))
    return out


def _whitened(rows: DataFrame, fit_list: DataFrame, size: int, n: int, components: int) -> DataFrame:
    sums = _summed(fit_list, size, size, lambda x: x.sum(0))
    whole, rest = np.divmod(sums, n)

    def centred(x: np.ndarray) -> np.ndarray:
        # the whole part of the mean leaves exactly
        return (x - whole).astype(np.float64) - rest / n

    def products(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return (c.T @ c).ravel()

    covariance = _summed(fit_list, size, size * size, products).reshape(size, size) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = eigen(covariance)
    k = min(components, size)
    total, varies = float(np.trace(covariance)), values[:k] > values[0] * size * 1e-15
    explained = values[:k] / total if total > 0 else np.zeros(k)
    matrix = np.where(varies, axes[:, :k] / np.sqrt(np.where(varies, values[:k], 1.0)), 0.0)

    def after(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ matrix
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    moments = _summed(fit_list, size, k + k * k, after) / n
    identity = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k])
    error = float(np.abs((identity - np.eye(k))[np.ix_(varies, varies)]).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                x = _matrix(part["x"], size)
                m, w = len(x), centred(x) @ matrix
                yield pa.RecordBatch.from_arrays(
                    [
                        part["vec_id"].take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        pa.array(np.repeat(np.array(_deviations(x, sums, n), object), k), pa.int64()), pa.array(w.ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return rows.where(F.size("x") == size).mapInArrow(run, OUT)


def _deviations(x: np.ndarray, sums: np.ndarray, n: int) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2, exact; None beyond 64 bits."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        away = n * x - sums
        if int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (away * away).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]
