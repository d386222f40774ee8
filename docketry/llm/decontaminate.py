"""Benchmark decontamination: passages of documents within an edit distance of a benchmark item.

Sequences are words. A CGK random walk (Chakraborty, Goldenberg and Koucky, 2016) copies a sequence into one three
times as long, and moves on after each copied symbol or stays, by a random bit of the place and the symbol; sequences at
edit distance e then differ in few places. Hashes of sampled places, over repeated walks, find pairs of item and
window; the exact edit distance decides.

Windows begin at every word, in each size that items have. A bound that loses nothing keeps them few: one edit changes
three word triples of a window at most, so a window within e edits of an item has at most 3 e triples (for short items:
e words) that no item of its size has.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import P, mix, slices, windows, words

#: Edits allowed, as a part of an item's words; walks, least hash tables per walk and most places per table.
EDITS, WALKS, TABLES, PLACES = 0.2, 5, 16, 8
#: Part of the pairs at the largest distance to find, for each size of items; pairs of which the walks are measured, and most tables.
RECALL, PAIRS, MOST_TABLES = 0.98, 64, 1024
TRIPLE = 3
#: The hash tables of all items (some eight times their bytes) are sent to the tasks, in blocks of so many bytes of items at most (or one larger item).
ITEM_BYTES = 4 << 20
FOUND = "doc_id long, item_id long, start int, edits int"


def cgk(sequences: np.ndarray, walk: int) -> np.ndarray:
    """Embeds rows of word hashes (n, length) into (n, 3 * length); beyond the end of a sequence stands 0."""
    n, length = sequences.shape
    padded = np.concatenate([sequences, np.zeros((n, 1), np.uint64)], 1)
    turns = mix(np.arange(3 * length, dtype=np.uint64) * P + np.uint64(walk))
    at, rows, out = np.zeros(n, np.int64), np.arange(n), np.empty((n, 3 * length), np.uint64)
    for step in range(3 * length):
        symbol = padded[rows, at]
        out[:, step] = symbol
        move = mix(symbol ^ turns[step]) & np.uint64(1)
        at = np.minimum(at + move.astype(np.int64), length)
    return out


def sampled(embedded: np.ndarray, walk: int, tables: int, places: int) -> np.ndarray:
    """(n, tables) hashes of the embedded symbols at random places."""
    pick = np.random.default_rng((walk, embedded.shape[1])).integers(0, embedded.shape[1], (tables, places))
    out = np.zeros((len(embedded), tables), np.uint64)
    for p in range(places):
        out = mix(out * P + embedded[:, pick[:, p]] + np.arange(tables, dtype=np.uint64))
    return out


def pairs_at(size: int, most: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n random sequences, and for each one that differs by so many edits: changed words for one half, words that are taken out
    and put in elsewhere for the other."""
    rng = np.random.default_rng((size, most))
    x = rng.integers(1, 1 << 60, (n, size)).astype(np.uint64)
    y = x.copy()
    for i in range(n):
        moved = most // 2 if i % 2 else 0
        row = np.delete(y[i], rng.choice(size, moved, replace=False))
        row = np.insert(row, rng.integers(0, len(row) + 1, moved), rng.integers(1, 1 << 60, moved).astype(np.uint64))
        changed = rng.choice(size, most - 2 * moved, replace=False)
        row[changed] = rng.integers(1, 1 << 60, len(changed)).astype(np.uint64)
        y[i] = row
    return x, y


@cache
def plan(size: int, edits: float, walks: int, tables: int, places: int) -> tuple[int, int]:
    """Tables per walk and places per table for items of a size: the most places, up to those given, with which the walks
    as measured at the largest distance find RECALL of the pairs; more tables where one place is too many.

    Beyond 64 words the next power of two is measured, as walks agree less in longer sequences.
    """
    measured = size if size <= 64 else 1 << (size - 1).bit_length()
    x, y = pairs_at(measured, int(edits * measured), PAIRS)
    agree = np.stack([(cgk(x, w) == cgk(y, w)).mean(1) for w in range(walks)])
    while True:
        for k in range(places, 0, -1):
            if 1 - np.prod((1 - agree**k) ** tables, 0).mean() >= RECALL:
                return tables, k
        if tables >= MOST_TABLES:
            return tables, 1
        tables *= 2


def edit_distance(x: np.ndarray, ys: np.ndarray, most: int) -> np.ndarray:
    """Of x to each row of ys (as long as x); only distances up to most are exact."""
    length = len(x)
    row = np.broadcast_to(np.arange(length + 1), (len(ys), length + 1)).copy()
    for i in range(1, length + 1):
        a, b = max(1, i - most), min(length, i + most)
        now = np.full_like(row, most + 1)
        now[:, 0] = i
        change = np.minimum(row[:, a - 1 : b] + (ys[:, a - 1 : b] != x[i - 1]), row[:, a : b + 1] + 1)
        for j in range(a, b + 1):
            now[:, j] = np.minimum(change[:, j - a], now[:, j - 1] + 1)
        row = now
    return row[:, length]


class Index:
    """The hash tables of items, by size."""

    def __init__(self, items: list[tuple[int, str]], edits: float, walks: int, tables: int, places: int):
        self.edits, self.walks = edits, walks
        self.ids, self.items = [], []
        ids, texts = [i for i, _ in items], pa.array([x for _, x in items], pa.string())
        for first, _, raw, at in slices(texts):
            hashes, _, _, first_word = words(raw, at, lower=True)
            for k, (a, b) in enumerate(zip(first_word[:-1], first_word[1:], strict=True)):
                if b > a:
                    self.ids.append(ids[first + k])
                    self.items.append(hashes[a:b])
        self.sizes = sorted({len(x) for x in self.items})
        self.runs = {k: self._runs(k) for k in (1, TRIPLE)}
        self.plans = {size: plan(size, edits, walks, tables, places) for size in self.sizes}
        self.of_size, self.keys = {}, {}
        for size in self.sizes:
            own = [i for i, x in enumerate(self.items) if len(x) == size]
            self.of_size[size] = np.array(own)
            rows = np.array([self.items[i] for i in own])
            for walk in range(walks):
                keys = sampled(cgk(rows, walk), walk, *self.plans[size])
                for t in range(keys.shape[1]):
                    order = np.argsort(keys[:, t], kind="stable")
                    self.keys[size, walk, t] = keys[order, t], self.of_size[size][order]

    def _runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct runs of k words of all items, which of them items of each size have, and a filter on 20 bits."""
        own = [windows(x, k) for x in self.items]
        known = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]))
        in_size = np.zeros((len(self.sizes), len(known)), bool)
        for x, item in zip(own, self.items, strict=True):
            in_size[self.sizes.index(len(item)), np.searchsorted(known, x)] = True
        bits = np.zeros(1 << 20, bool)
        bits[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return known, in_size, bits

    def hits(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs of k words that some item has, and the numbers of the runs."""
        here, (known, _, bits) = windows(hashes, k), self.runs[k]
        some = np.flatnonzero(bits[(here & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(known, here[some]), max(len(known) - 1, 0))
        right = known[place] == here[some]
        return some[right], place[right]

    def starts(self, n: int, at: np.ndarray, size: int, k: int, most: int) -> np.ndarray:
        """Starts of the windows of a size, of n words in all, with k * most runs at most that are not among those at."""
        need = size - k + 1 - k * most
        if len(at) < need or not (at[need - 1 :] - at[: len(at) - need + 1] <= size - k).any():
            return at[:0]
        flags = np.zeros(n + 1, np.int32)
        flags[at + 1] = 1
        total = np.cumsum(flags, dtype=np.int32)
        last = n - size + 1
        return np.flatnonzero(total[size - k + 1 : size - k + 1 + last] - total[:last] >= need)

    def windows(self, hashes: np.ndarray, first_word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """size, words, text, first word in the text of the windows that the bound leaves."""
        if len(hashes) < min(self.sizes, default=len(hashes) + 1):
            return
        found = {k: self.hits(hashes, k) for k in (1, TRIPLE)}
        for number, size in enumerate(self.sizes):
            most = int(self.edits * size)
            if len(hashes) < size:
                break
            k = TRIPLE if size - TRIPLE + 1 - TRIPLE * most > 0 else 1
            at, runs = found[k]
            start = self.starts(len(hashes), at[self.runs[k][1][number, runs]], size, k, most)
            text = np.searchsorted(first_word, start, "right") - 1
            inside = start + size <= first_word[text + 1]
            start, text = start[inside], text[inside]
            if len(start):
                yield size, hashes[start[:, None] + np.arange(size)], text, start - first_word[text]

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """text, item number, first word of the window in its text, edits: every pair of window and item found."""
        by_size, out = {}, []
        for first, _, raw, at in slices(texts):
            hashes, _, _, first_word = words(raw, at, lower=True)
            for size, rows, text, start in self.windows(hashes, first_word):
                by_size.setdefault(size, []).append((rows, text + first, start))
        for size, parts in by_size.items():
            rows, text, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            # equal windows are looked up once
            rows, back = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(back, kind="stable")
            cuts = np.searchsorted(back[order], np.arange(len(rows) + 1))
            for low in range(0, len(rows), 8192):
                for r, item, edits in self._near(rows[low : low + 8192], size, int(self.edits * size)):
                    for w in order[cuts[low + r] : cuts[low + r + 1]]:
                        out.append((int(text[w]), item, int(start[w]), edits))
        return out

    def _near(self, rows: np.ndarray, size: int, most: int) -> list[tuple[int, int, int]]:
        pairs = []
        for walk in range(self.walks):
            keys = sampled(cgk(rows, walk), walk, *self.plans[size])
            for t in range(keys.shape[1]):
                known, items = self.keys[size, walk, t]
                a, b = np.searchsorted(known, keys[:, t], "left"), np.searchsorted(known, keys[:, t], "right")
                hit = np.flatnonzero(b > a)
                if len(hit):
                    times = b[hit] - a[hit]
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    pairs.append(np.stack([np.repeat(hit, times), items[np.repeat(a[hit], times) + step]], 1))
        if not pairs:
            return []
        pairs, out = np.unique(np.concatenate(pairs), axis=0), []
        for item in np.unique(pairs[:, 1]):
            own = pairs[pairs[:, 1] == item, 0]
            d = edit_distance(self.items[item], rows[own], most)
            out += [(int(r), int(item), int(x)) for r, x in zip(own, d, strict=True) if x <= most]
        return out


def _blocks(items: Iterable[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Runs of items with ITEM_BYTES of text at most; a larger item is a block of its own."""
    block, size = [], 0
    for item_id, text in items:
        n = len(text.encode())
        if block and size + n > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    if block:
        yield block


def _search(docs: DataFrame, sent: Broadcast[Index]) -> DataFrame:
    """doc_id, item_id, start, edits of one block of items."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for text, item, start, n in index.find(batch["text"]):
                best[text, item] = min(best.get((text, item), (n, start)), (n, start))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array([t for t, _ in best], pa.int64())), pa.array([index.ids[i] for _, i in best], pa.int64()),
                    pa.array([s for _, s in best.values()], pa.int32()), pa.array([n for n, _ in best.values()], pa.int32()),
                ],
                names=["doc_id", "item_id", "start", "edits"],
            )

    return docs.select("doc_id", "text").mapInArrow(search, FOUND)


def find_leaks(
    docs: DataFrame, items: DataFrame, edits: float = EDITS, walks: int = WALKS, tables: int = TABLES, places: int = PLACES
) -> DataFrame:
    """doc_id, item_id, start, edits: for each row of docs and each item found in it, the best window.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased. A window of as many words as the item
    has counts if its edit distance is at most edits * words (rounded down); of several windows that with fewest edits
    and then the first is told, start counts words from 0. Null or empty texts and items match nothing; items with
    equal ids are items of their own that share a name; rows that repeat are searched each. Items are collected in
    blocks of ITEM_BYTES of text, documents stay in their partitions and are searched once per block. Tables and places
    follow the size of the item (see plan), from the least tables and most places given; windows without edits are
    always found, as equal sequences have equal walks.
    """
    own = items.where("text is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    read = own.select("item_id", "text")
    if size <= ITEM_BYTES:
        texts = [(r["item_id"], r["text"]) for r in read.collect()]
        return _search(docs, docs.sparkSession.sparkContext.broadcast(Index(texts, edits, walks, tables, places)))
    parts = []
    for texts in _blocks((r["item_id"], r["text"]) for r in read.repartition(math.ceil(size / ITEM_BYTES)).toLocalIterator()):
        sent = docs.sparkSession.sparkContext.broadcast(Index(texts, edits, walks, tables, places))
        parts.append(stored(_search(docs, sent)))
        sent.destroy()
    return reduce(DataFrame.unionAll, parts)
