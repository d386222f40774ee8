"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one vector kept per group.

Each vector lives in the cell of its nearest centre and visits the cells whose centres are not much farther. In a cell
the vectors that live there are compared with all that are there; visitors are not compared with one another.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Vectors that k-means sees at most (the smallest hashes); every vector is put into cells.
SAMPLE, CELL, MAX_CELLS = 16_384, 256, 1024
#: Of a cell, vectors that live there and vectors they are compared with in one group, at most about; rows of one product.
BLOCK, OTHERS, ROWS = 2048, 8192, 256
#: A vector also visits cells whose centre is at most so many degrees farther than the nearest. Of two vectors at angle f
#: one visits the other's cell for certain where 2 f <= MARGIN, and nearly always beyond: the angles to a centre differ by about f / sqrt(dimensions).
MARGIN = 8.0


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres; x holds unit rows. An empty cell takes the row farthest from its centre."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        like = x @ centres.T
        cell = like.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1)
        sums[norms < 1e-12] = x[like.max(1).argmin()]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length 1; the lists are of one length and hold no null."""
    x = np.asarray(pc.list_flatten(column)).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each of n nodes by the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, cell: int = CELL, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    Vectors link when their cosine, in double precision, is at least ``cosine``; n_links counts other rows linked
    directly, component_id is the smallest vec_id that links lead to, and kept marks the row of that id. A vector
    that is null, empty, zero, or holds nulls or values that are not finite links with nothing; so do vectors of
    different lengths with one another. Rows with the same embedding link to one another; a null vec_id counts as a
    row, names no component and is kept only if nothing in its component has an id.
    """
    e = F.col("embedding")
    clean = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(
        "vec_id", F.when(F.coalesce(clean, F.lit(False)), F.transform(e, lambda v: v.cast("double") + 0.0)).alias("e")
    ).select("vec_id", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("class"), "e")
    classes = stored(
        rows.where("class is not null").groupBy("class").agg(F.first("e").alias("e"), F.count("*").alias("copies")).withColumn("size", F.size("e"))
    )
    links, edges = _compare(classes, cosine, cell, margin)

    of = components(edges)
    known = rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    known = known.join(of, known["class"] == of["node"], "left").join(
        links.groupBy("class").agg(F.sum("n").alias("n")), "class", "left"
    ).select("class", F.coalesce("component", "class").alias("component"), "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    named = known.join(known.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", "n_links", "component_id")
    return (
        rows.select("vec_id", "class").join(named, "class", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def _compare(classes: DataFrame, cosine: float, cell: int, margin: float) -> tuple[DataFrame, DataFrame]:
    """class, n (rows linked with it, once per pair of classes); and a forest a, b of the links."""
    spark = classes.sparkSession
    sizes = [(r["size"], r["count"]) for r in classes.groupBy("size").count().collect()]
    centres = {}
    for size, count in sizes:
        sample = classes.where(F.col("size") == size).orderBy(F.xxhash64("class")).limit(SAMPLE).select("e").toArrow()
        x = _unit(sample["e"])
        centres[size] = spherical_kmeans(x, max(1, min(len(x), MAX_CELLS, math.ceil(count / cell))))

    def assign(batches):
        for t in batches:
            size = np.array(t["size"])
            for s in np.unique(size):
                own = t.filter(pa.array(size == s))
                x = _unit(own["e"])
                angle = np.degrees(np.arccos(np.clip(x @ centres[s].T, -1, 1)))
                near = angle <= angle.min(1, keepdims=True) + margin
                row, c = np.nonzero(near)
                home = angle.argmin(1).astype(np.int32)[row]
                lives = home == c
                cells = [np.flatnonzero(r).astype(np.int32) for r in near]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c.astype(np.int32)), pa.array(home), *(own[k].take(pa.array(row)) for k in ("size", "class", "copies", "e")),
                        pa.array([cells[r] if here else None for r, here in zip(row, lives, strict=True)], pa.list_(pa.int32())),
                    ],
                    names=["cell", "home", "size", "class", "copies", "e", "cells"],
                )

    put = stored(classes.mapInArrow(assign, "cell int, home int, size int, class long, copies long, e array<double>, cells array<int>"))
    lives = F.col("cell") == F.col("home")
    # at most MAX_CELLS rows for each length of vector
    parts = put.groupBy("size", "cell").agg(
        F.greatest(F.ceil(F.count_if(lives) / BLOCK), F.lit(1)).cast("int").alias("blocks"), F.ceil(F.count("*") / OTHERS).cast("int").alias("others")
    )

    def part(of: str):
        return F.pmod(F.xxhash64("class", "cell"), of).cast("int")

    def every(of: str, place):
        return F.transform(F.sequence(F.lit(0), F.col(of) - 1), place)

    as_left = every("others", lambda j: F.struct(part("blocks").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    as_right = every("blocks", lambda i: F.struct(i.alias("i"), part("others").alias("j"), F.lit(False).alias("left")))
    dealt = put.join(parts, ["size", "cell"]).select(
        "cell", "home", "size", "class", "copies", "e", "cells", F.inline(F.when(lives, F.concat(as_left, as_right)).otherwise(as_right))
    )

    def compare(t: pa.Table) -> pa.Table:
        here, side = t["cell"][0].as_py(), np.array(t["left"])
        x, ids, copies, home = _unit(t["e"]), np.array(t["class"]), np.array(t["copies"], np.float64), np.array(t["home"])
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        visits = home[right] != here
        # a pair that each other's cells see is counted in the cell with the smaller number
        other = np.zeros((len(left), max(int(home.max()), here) + 1), bool)
        for row, cells in enumerate(t["cells"].filter(pa.array(side)).to_pylist()):
            other[row, [c for c in cells if c < min(here, other.shape[1])]] = True
        n, label = np.zeros(len(ids)), np.arange(len(ids))
        for low in range(0, len(left), ROWS):
            rows = left[low : low + ROWS]
            link = x[rows] @ x[right].T >= cosine
            link &= (ids[rows][:, None] != ids[right]) & ~(other[low : low + ROWS][:, home[right]] & visits)
            n[rows] += link @ copies[right]
            # two that live here meet twice, once from either side
            n[right[visits]] += copies[rows] @ link[:, visits]
            while True:
                open_ = link & (label[rows][:, None] != label[right])
                some = np.flatnonzero(open_.any(1))
                if not len(some):
                    break
                met = right[open_[some].argmax(1)]
                label = _forest(len(ids), np.concatenate([np.arange(len(ids)), rows[some]]), np.concatenate([label, met]))
        some = np.flatnonzero((n > 0) | (label != np.arange(len(ids))))
        return pa.table({"class": pa.array(ids[some]), "n": pa.array(n[some].astype(np.int64)), "first": pa.array(ids[label[some]])})

    found = stored(dealt.groupBy("size", "cell", "i", "j").applyInArrow(compare, "class long, n long, first long"))
    return found.select("class", "n"), found.select(F.col("class").alias("a"), F.col("first").alias("b"))
