"""Toxicity by a linear classifier on character n-grams that naive Bayes log-count ratios scale (Wang and Manning, 2012)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled
from .words import mix, windows

#: Labelled texts the classifier is fitted on at most (the smallest hashed ids); lengths of n-grams; hash bits; buckets
#: that keep a weight (those whose log-count ratio, times the root of the count, is farthest from 0).
SAMPLE, ORDERS, BITS, KEPT = 20_000, (5, 7), 18, 6_000
SMOOTHING, RIDGE, STEPS, RATE = 1.0, 1e-4, 400, 0.05
SLICE = 256


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Per text, in order: the sorted distinct buckets of its lower-cased n-grams."""
    seen = np.zeros(1 << BITS, bool)
    for low in range(0, len(texts), SLICE):
        part = [(x or "").lower() for x in texts[low : low + SLICE]]
        codes = mix(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
        grams = [(n, (windows(codes, n) >> np.uint64(64 - BITS)).astype(np.int32)) for n in ORDERS]
        at = np.cumsum([0, *map(len, part)])
        for a, b in zip(at, at[1:], strict=False):
            for n, g in grams:
                seen[g[a : max(a, b - n + 1)]] = True
            own = np.flatnonzero(seen)
            seen[own] = False
            yield own.astype(np.int32)


class Model:
    """weights by bucket, and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = np.array([self.weights[f].sum() for f in features(texts)], np.float64) + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _logistic(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse 0/1 features times scale, by Adam steps over all rows."""
    w, b, m, v = np.zeros(len(scale)), 0.0, np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for step in range(1, STEPS + 1):
        margin = np.bincount(rows, (w * scale)[columns], len(y)) + b
        error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y
        g = np.append(np.bincount(columns, error[rows], len(scale)) * scale / len(y) + RIDGE * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, learn: Column, column: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled rows of docs. With rows of one label only, the score is their share of
    label 1 (smoothed by one row of each label); without rows it is a half."""
    chosen = labelled(docs, labels, column, learn, sample)
    # at most `sample` ids and labels: some hundred kilobytes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for y, f in zip(batch["label"].to_pylist(), features(batch["text"].to_pylist()), strict=True):
                found[y, f] += 1
        some = np.flatnonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[0, some]), pa.array(found[1, some])], names=["bucket", "n0", "n1"])

    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = total.get(0, 0), total.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(1 << BITS), float(np.log((n1 + 1) / (n0 + 1))))
    # one row per bucket at most
    counts = rows.mapInArrow(count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    bucket, c0, c1 = (np.array(counts[k], np.float64) for k in ("bucket", "n0", "n1"))
    ratio = np.log((c1 + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((c0 + SMOOTHING) / (n0 + 2 * SMOOTHING))
    best = np.argsort(-np.abs(ratio) * np.sqrt(c0 + c1), kind="stable")[:KEPT]
    ids, ratio = bucket[best].astype(np.int32), ratio[best]
    column_of = np.full(1 << BITS, -1, np.int32)
    column_of[ids] = np.arange(len(ids))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [column_of[f] for f in features(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["label"].cast(pa.int32()), pa.array([x[x >= 0].astype(np.int16).tobytes() for x in own], pa.binary())], names=["label", "columns"]
            )

    # at most `sample` rows of KEPT two-byte numbers
    found = rows.mapInArrow(kept, "label int, columns binary").toArrow()
    columns = [np.frombuffer(x.as_buffer(), np.int16) for x in found["columns"]]
    row = np.repeat(np.arange(len(columns)), [len(x) for x in columns])
    w, b = _logistic(row, np.concatenate(columns).astype(np.int64), ratio, np.array(found["label"], np.float64))
    weights = np.zeros(1 << BITS)
    weights[ids] = w * ratio
    return Model(weights, float(b))


def score_texts(docs: DataFrame, model: Model, threshold: float, into: str = "score") -> DataFrame:
    """docs with ``into`` (0 to 1) and predicted (1 if at least threshold). Null texts score as empty ones; every row is
    scored by its text alone, so repeated rows and null ids are no special case."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in (into, "predicted")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.score(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, into, "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*names).mapInArrow(run, f"{schema}, `{into}` double, predicted int")
