"""Quality by random Fourier features of document statistics, ridge regression and isotonic calibration.

Normal equations are summed in the partitions and once more over their results; scores are calibrated on rows that the
ridge fit did not see, by the pool of adjacent violators over a bounded number of score bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled

FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 3.0, 1e-3, 2_000, 11
#: Texts described at a time in a batch.
ROWS = 256
#: Every so manieth learning row (by hashed id) calibrates; the others fit.
CALIBRATE = 4
STATISTICS = (
    "log_words", "mean_word", "sd_word", "distinct", "top_word", "adjacent", "upper", "upper_words", "digit", "symbol",
    "sentence_marks", "bar", "odd_marks", "line_length", "repeated_lines", "non_ascii",
)
_CLASS = np.zeros(256, np.uint8)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
    _CLASS[np.frombuffer(_set, np.uint8)] = _k
_CLASS[128:] = 7


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text; all 0 without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = raw.split(b"\n")
    adjacent = sum(map(bytes.__eq__, words, words[1:])) / n
    return [
        np.log1p(n), lengths.mean() / 10, min(lengths.std() / 10, 3.0), len(seen) / n, max(seen.values()) / n, adjacent,
        kinds[1], sum(map(bytes.isupper, words)) / n, kinds[2] * 4, kinds[6] * 4, kinds[3] * 4, min(kinds[5] * 20, 3.0), min(kinds[4] * 20, 3.0),
        np.log1p(size / len(lines)) / 5, 1 - len(set(lines)) / len(lines), kinds[7],
    ]


def _fourier(x: np.ndarray) -> np.ndarray:
    """sqrt(2 / D) cos(w x + b) with Gaussian w: inner products approximate exp(-|x - y|^2 / (2 WIDTH^2)); and a constant."""
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(0, 1 / WIDTH, (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(x @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


class Model:
    """Standardised statistics, ridge weights and the steps of the calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, edges: np.ndarray, levels: np.ndarray):
        self.mean, self.scale, self.weights, self.edges, self.levels = mean, scale, weights, edges, levels

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return _fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(x), self.edges, self.levels) if len(x) else np.zeros(0)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rising values nearest to the means y with weights n."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, k = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + k]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _arrays(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch["x"].to_pylist(), np.float64).reshape(-1, len(STATISTICS))


def described(docs: DataFrame) -> DataFrame:
    """docs without text, with x: the statistics of the text."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in batch["text"].to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), x], names=[*(f.name for f in kept), "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*(f.name for f in kept), "text").mapInArrow(run, f"{schema}, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, learn: Column, column: str = "quality") -> Model:
    """Learns from all labelled rows of stats (doc_id, x) that ``learn`` allows. Without such rows the score is a half;
    with one label only it is their share of label 1, smoothed by a row of each label."""
    rows = stats.select("doc_id", "x").join(labelled(stats, labels, column, learn), "doc_id").withColumn(
        "calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0
    )
    k = len(STATISTICS)
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(k)] + [F.sum(F.get("x", F.lit(i)) ** 2).alias(f"q{i}") for i in range(k)]
    got = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *sums).first()
    n, ones = got["n"], got["ones"] or 0
    if ones in (0, n):
        return Model(np.zeros(k), np.ones(k), np.zeros(FEATURES + 1), np.array([0.0]), np.array([(ones + 1) / (n + 2)]))
    mean = np.array([got[f"s{i}"] for i in range(k)]) / n
    scale = np.sqrt(np.maximum(np.array([got[f"q{i}"] for i in range(k)]) / n - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = _fourier((_arrays(batch) - mean) / scale)
            a += z.T @ z
            b += z.T @ np.array(batch["label"], np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(np.column_stack([a, b]).tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    fitted = rows.where("not calibrates").mapInArrow(normal, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    parts = fitted.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    system[np.array(parts["i"]), np.array(parts["j"])] = np.array(parts["v"])
    weights = np.linalg.solve(system[:, :-1] + RIDGE * max(n, 1) * np.eye(FEATURES + 1) / FEATURES, system[:, -1])
    model = Model(mean, scale, weights, np.array([0.0]), np.array([0.5]))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.round((model.ridge(_arrays(batch)) + 0.5) / 2 * BINS), 0, BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch["label"].cast(pa.int32())], names=["bin", "label"])

    # BINS + 1 rows at most
    held = sorted(rows.where("calibrates").mapInArrow(bins, "bin int, label int").groupBy("bin").agg(F.avg("label").alias("y"), F.count("*").alias("n")).collect())
    if held:
        model.edges = np.array([r["bin"] for r in held]) * 2 / BINS - 0.5
        model.levels = isotonic(np.array([r["y"] for r in held]), np.array([r["n"] for r in held], np.float64))
    else:
        model.edges, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1; null texts score as empty ones. Only the texts travel to Python, some at a time."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            parts = [model.score(np.array([statistics(t) for t in batch.iloc[low : low + ROWS]])) for low in range(0, len(batch), ROWS)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored(text)


def score_texts(rows: DataFrame, model: Model, threshold: float) -> DataFrame:
    """rows with score (0 to 1) and predicted (1 if at least threshold), from text, or from x if there is such a
    column. Null texts score as empty ones; each row is scored by itself."""
    from_text = "x" not in rows.columns
    kept = [f for f in rows.schema.fields if f.name not in ("score", "predicted", *(() if from_text else ("x",)))]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"].to_pylist()]).reshape(-1, len(STATISTICS)) if from_text else _arrays(batch)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")
