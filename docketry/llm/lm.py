"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform distribution.

Maximum-likelihood estimates of both orders are mixed with weights that depend on how often the context was seen.
The weights are learned by expectation-maximisation on deleted counts: each training token is held out in turn, so its
own occurrence is taken off the counts that predict it. What EM needs of the corpus is a table of bounded size (cells of
context bucket and rounded probabilities, with counts and mean probabilities); n-gram counts cover all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tally
from .common import n_blocks, stored
from .words import P, mix, slices, words

#: Tokens after which a block is closed.
BLOCK_TOKENS = 2_000_000
BUCKETS, EM_ROUNDS, LEAST_WEIGHT = 20, 60, 1e-6
#: The end of a text; also the context of its first word. No word hashes to it but by a chance of 2**-64.
END = np.uint64(0x5851F42D4C957F2D)
BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, n array<int>, n_train long, vocabulary binary, tokens binary"
COUNTED = "doc_ids array<long>, held_out array<boolean>, n array<int>, tokens binary, uni binary, bi binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a partition as numbers into the block's distinct word hashes, the most frequent ones first."""
    ids, held, sizes, hashes, tokens, number = [], [], [], [], 0, 0
    here = TaskContext.get().partitionId()

    def close() -> pa.RecordBatch:
        vocabulary, place, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # small numbers for frequent words
        vocabulary, place = vocabulary[order], np.argsort(order, kind="stable")[place]
        n, out = np.concatenate(sizes), np.concatenate(held)
        row = (
            here << 24 | number, np.concatenate(ids).tolist(), out.tolist(), n.tolist(), int(n[~out].sum()),
            vocabulary.tobytes(), tally.squeezed(place.astype(np.uint32)),
        )
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary())
        names = ["block", "doc_ids", "held_out", "n", "n_train", "vocabulary", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    for batch in batches:
        doc_ids = np.array(batch["doc_id"].to_pylist(), object)
        out = np.array(batch["held_out"])
        for first, end, raw, at in slices(batch["text"]):
            h, _, _, first_word = words(raw, at, lower=True)
            ids.append(doc_ids[first:end])
            held.append(out[first:end])
            sizes.append((np.diff(first_word) + 1).astype(np.int32))
            hashes.append(np.insert(h, first_word[1:], END))
            tokens += len(hashes[-1])
            if tokens >= BLOCK_TOKENS:
                yield close()
                ids, held, sizes, hashes, tokens, number = [], [], [], [], 0, number + 1
    if hashes:
        yield close()


def _pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, token numbers, context numbers, bigram hashes, which tokens are of training texts."""
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    token = tally.restored(row["tokens"], np.uint32)
    n = np.array(row["n"])
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[np.cumsum(n) - n] = token[-1]  # the last token ends a text
    return vocabulary, token, context, mix(vocabulary[context] * P + vocabulary[token]), ~np.repeat(np.array(row["held_out"], bool), n)


def _context(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, bigram, context and word counts and training flags by token."""
    for row in t.to_pylist():
        n, token = np.array(row["n"]), tally.restored(row["tokens"], np.uint32)
        uni, bi = tally.restored(row["uni"], np.int64), tally.restored(row["bi"], np.uint32).astype(np.int64)
        cw = uni[token]
        cv = np.empty_like(cw)
        cv[1:] = cw[:-1]
        cv[np.cumsum(n) - n] = cw[-1]  # the last token ends a text
        yield row, bi, cv, cw, ~np.repeat(np.array(row["held_out"], bool), n)


def bucket(cv: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(cv + 1.0).astype(np.int64), BUCKETS - 1)


def learn_weights(cells: dict[str, np.ndarray], vocabulary: int) -> np.ndarray:
    """Weights of bigram, unigram and uniform estimates per bucket: cells of bucket, n, p2, p1 (means)."""
    p = np.stack([cells["p2"], cells["p1"], np.full(len(cells["n"]), 1 / (vocabulary + 1))], 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(EM_ROUNDS):
        share = weights[cells["bucket"]] * p
        share *= (cells["n"] / share.sum(1))[:, None]
        sums = np.zeros((BUCKETS, 3))
        np.add.at(sums, cells["bucket"], share)
        seen = sums.sum(1) > 0
        weights[seen] = np.maximum(sums[seen] / sums[seen].sum(1, keepdims=True), LEAST_WEIGHT)
        weights /= weights.sum(1, keepdims=True)
    return weights


def score_texts(docs: DataFrame, held_out: Column, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Tokens: words (runs of characters other than space and 0x09-0x0D, A-Z lower-cased), then one end; null and empty
    texts are an end alone. The model learns from rows that held_out does not mark (null: not marked); rows that repeat
    count each time. n_known counts tokens seen in training texts, train_tokens all tokens there. base_score is the
    log10 probability under add-one unigrams, score under the mixture. With no training text every token has the
    uniform probability. Words are told apart by 64-bit hashes; bigram counts share 32 bits besides the shard, which
    adds other counts to about one bigram in some thousands.
    """
    shards = shards or n_blocks(docs)
    d = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = stored(d.mapInArrow(_blocks, BLOCKS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            vocabulary, token, _, pair, train = _pairs(row)
            counts = np.bincount(token[train], minlength=len(vocabulary))
            order = np.lexsort((vocabulary, (vocabulary >> np.uint64(32)) % np.uint64(shards)))
            yield from tally.request(row["block"], vocabulary[order], counts[order], shards, wide=True).to_batches()
            names, place = np.unique(tally.named(pair, shards), return_inverse=True)
            yield from tally.request(row["block"], names, np.bincount(place[train], minlength=len(names)), shards, wide=False).to_batches()

    def answer(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
        return total if keys.dtype == np.uint64 else np.minimum(total, 0xFFFFFFFF).astype(np.uint32)

    def put_together(t: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in t.to_pylist():
            vocabulary, _, _, pair, _ = _pairs(row)
            order = np.lexsort((vocabulary, (vocabulary >> np.uint64(32)) % np.uint64(shards)))
            uni = np.empty(len(vocabulary), np.int64)
            uni[order] = tally.joined(answers, np.int64, wide=True)
            names, place = np.unique(tally.named(pair, shards), return_inverse=True)
            bi = tally.joined(answers, np.uint32, wide=False)[place]
            out.append({k: row[k] for k in ("doc_ids", "held_out", "n", "tokens")} | {"uni": tally.squeezed(uni), "bi": tally.squeezed(bi), "distinct": None})
        if not out:  # what shards say of themselves
            out = [{"distinct": sum(int(x.as_py()) for x in answers["found"])}]
        return pa.Table.from_pylist(out, COUNTED_ARROW)

    answers = tally.answered(blocks.mapInArrow(ask, tally.REQUEST), answer, distinct=True)
    counted = stored(
        blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put_together, f"{COUNTED}, distinct long")
    )
    train_tokens = blocks.agg(F.sum("n_train")).first()[0] or 0
    distinct = counted.agg(F.sum("distinct")).first()[0] or 0
    counted = counted.where("distinct is null").drop("distinct")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bi, cv, cw, train in _context(batch):
                bi, cv, cw = (x[train] - 1 for x in (bi, cv, cw))
                p2 = np.minimum(bi / np.maximum(cv, 1), 1) * (cv > 0)
                p1 = cw / max(train_tokens - 1, 1)
                q2, q1 = (np.where(p > 0, np.minimum(1 - 2 * np.log2(np.where(p > 0, p, 1)), 99), 0).astype(np.int64) for p in (p2, p1))
                cell = (bucket(cv) * 100 + q2) * 100 + q1
                found, place, n = np.unique(cell, return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(n), *(pa.array(np.bincount(place, p, len(found)).astype(np.float64)) for p in (p2, p1))],
                    names=["cell", "n", "p2", "p1"],
                )

    # 200,000 cells at most, whatever the corpus
    table = counted.mapInArrow(cells, "cell long, n long, p2 double, p1 double").groupBy("cell").agg(
        F.sum("n").alias("n"), (F.sum("p2") / F.sum("n")).alias("p2"), (F.sum("p1") / F.sum("n")).alias("p1")
    ).toArrow()
    known = {k: np.array(table[k]) for k in ("n", "p2", "p1")} | {"bucket": np.array(table["cell"], np.int64) // 10_000}
    weights = learn_weights(known, distinct) if train_tokens else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, bi, cv, cw, _ in _context(batch):
                w = weights[bucket(cv)]
                p = w[:, 0] * np.minimum(bi / np.maximum(cv, 1), 1) + w[:, 1] * (cw / max(train_tokens, 1)) + w[:, 2] / (distinct + 1)
                base = np.log10((cw + 1.0) / (train_tokens + distinct + 1.0))
                n = np.array(row["n"])
                at = np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(n.astype(np.int64)),
                        pa.array(np.add.reduceat((cw > 0).astype(np.int64), at)), pa.array(np.full(len(n), train_tokens)),
                        pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counted.mapInArrow(score, SCORES)


COUNTED_ARROW = pa.schema(
    [("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32())), ("tokens", pa.binary()),
     ("uni", pa.binary()), ("bi", pa.binary()), ("distinct", pa.int64())]
)
