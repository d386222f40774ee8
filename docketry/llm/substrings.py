"""Substring deduplication by level-wise doubling.

Windows of half the length are counted everywhere; those that occur once are settled. Only where both halves of a
full window are repeated is the window of twice the length counted, and only repeated ones remove words. No window
longer than the asked length needs counting: all its words lie in repeated windows of that length.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tally
from .common import in_blocks, n_blocks
from .words import slices, whole, windows, words

OUT = "doc_id long, text string, n_words long, n_removed long"


def _levels(t: pa.Table, half: int, length: int):
    """Per slice of the block's texts: word hashes, first words, hashes of half windows, which of them are whole."""
    for first, end, raw, at in slices(t["text"]):
        hashes, _, _, first_word = words(raw, at)
        short = windows(hashes, half)
        yield first, end, raw, at, hashes, first_word, short, whole(first_word, half, len(short))


def drop_repeats(docs: DataFrame, length: int = 35, blocks: int | None = None) -> DataFrame:
    """doc_id, text (words kept, one space between), n_words, n_removed for each row of docs.

    Words are runs of characters other than space and 0x09-0x0D. A word goes if a window of ``length`` words that
    covers it starts at another place too, in the same text or any other, as judged on the input. Null texts have
    no words and give an empty text; so do empty ones. Rows repeated with one doc_id count as different documents;
    a null doc_id stays. Other columns of docs are not looked at.
    """
    if length < 2:
        raise ValueError("length must be 2 or more")
    half, blocks = (length + 1) // 2, blocks or n_blocks(docs)
    d = in_blocks(docs, blocks)

    def ask_half(t: pa.Table) -> pa.Table:
        parts = [short[ok] for *_, short, ok in _levels(t, half, length)]
        found, counts = tally.by_shard(np.concatenate(parts), blocks, wide=False)
        return tally.request(t["block"][0].as_py(), found, np.minimum(counts, 2), blocks, wide=False)

    def ask_full(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t):
            return tally.REQUEST_ARROW.empty_table()
        levels = list(_levels(t, half, length))
        names, _ = tally.by_shard(np.concatenate([x[-2][x[-1]] for x in levels]), blocks, wide=False)
        repeated = tally.joined(answers, np.uint8, wide=False).astype(bool)
        parts = [np.zeros(0, np.uint64)]
        for *_, hashes, first_word, short, ok in levels:
            full = windows(hashes, length)
            if not len(full):
                continue
            again = np.zeros(len(short), bool)
            again[ok] = repeated[np.searchsorted(names, tally.named(short[ok], blocks))]
            # a full window is its first half and the half that ends with it
            parts.append(full[whole(first_word, length, len(full)) & again[: len(full)] & again[length - half :]])
        found, counts = tally.by_shard(np.concatenate(parts), blocks, wide=True)
        return tally.request(t["block"][0].as_py(), found, np.minimum(counts, 2), blocks, wide=True)

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        repeated = np.sort(tally.joined(answers, np.uint64, wide=True))
        texts, n_words, n_removed = [], [], []
        for _, _, raw, at in slices(t["text"]):
            hashes, _, _, first_word = words(raw, at)
            gone = np.zeros(len(hashes), bool)
            full = windows(hashes, length)
            if len(full) and len(repeated):
                place = np.minimum(np.searchsorted(repeated, full), len(repeated) - 1)
                hit = (repeated[place] == full) & whole(first_word, length, len(full))
                edges = np.zeros(len(hashes) + 1, np.int64)
                edges[: len(full)] += hit
                edges[length : length + len(full)] -= hit
                gone = np.cumsum(edges[:-1]) > 0
            data = raw.tobytes()
            for i in range(len(at) - 1):
                kept, own = data[at[i] : at[i + 1]].split(), gone[first_word[i] : first_word[i + 1]]
                n_words.append(len(kept))
                n_removed.append(int(own.sum()))
                texts.append(b" ".join(compress(kept, (~own).tolist()) if n_removed[-1] else kept))
        return pa.table(
            {
                "doc_id": t["doc_id"], "text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            }
        )

    def twice(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
        return (total > 1).astype(np.uint8)

    first = tally.answered(d.groupBy("block").applyInArrow(ask_half, tally.REQUEST), twice)
    second = tally.answered(
        d.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask_full, tally.REQUEST),
        lambda keys, total: keys[total > 1],
    )
    return d.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(cut, OUT)
