"""Byte-level BPE: ranked merges over the distinct pieces of a slice of texts at once; decoding joins binary pieces.

A text is cut at single spaces into chunks (a space and what follows it), which the split pattern never matches across.
Chunks are counted over all texts and the most frequent ones are encoded once and sent to the tasks: a dictionary of
bounded size, made from all the data. Chunks outside it are encoded where they stand, the distinct pieces of some hundred
texts together, once. Both go through the same merges (``Vocabulary.encoded``). So no text, and no row per token, is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Chunks in the dictionary that is sent to the tasks (some 60 bytes each), and chunks counted before a task gives counts on.
DICTIONARY, COUNTED = 300_000, 1_000_000
#: Cells of the rank map, a prime some times the number of merges; one that holds no merge (65535 is no id).
CELLS, EMPTY = 524_287, 65_535 << 32
#: Above all ranks.
NO_TOKEN = 65_536
#: Texts whose pieces are merged together, and bytes from which on a piece is merged by itself, with a heap.
TOGETHER, LONG = 512, 64
#: Where a chunk may not begin or end at a space: blanks at both sides of it, or a blank and the end.
LOOSE = regex.compile(r"\s\x20(?:\s|\z)")


class Vocabulary:
    """Tokens by rank (a tiktoken file: base64 of the bytes, a space, the rank) and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = pattern
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ranks = ranks

    def merges(self) -> np.ndarray:
        """Rows left id, right id, id of both together; ids are ranks."""
        return np.array(
            [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
             if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None], np.int64
        )

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    @cached_property
    def cells(self) -> np.ndarray:
        """The rank map: a pair of ids is in one of its two cells (cuckoo hashing), as left << 32 | right << 16 | rank.

        The cell XOR the pair is the rank, or 65536 and more if it holds another pair.
        """
        held: dict[int, tuple[int, int, int]] = {}
        for left, right, rank in self.merges().tolist():
            pair, at = (left, right, rank), None
            for _ in range(500):
                one, two = _places(*pair[:2])
                at = one if one not in held or at == two else two
                held[at], pair = pair, held.get(at)
                if pair is None:
                    break
            else:
                raise ValueError("the rank map has no place for a merge")
        packed = np.full(CELLS, EMPTY, np.int64)
        for at, (left, right, rank) in held.items():
            packed[at] = left << 32 | right << 16 | rank
        return packed

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbours; NO_TOKEN for those that are no token together."""
        pair = left << 32 | right << 16
        one, two = (self.cells[at] ^ pair for at in _places(left, right))
        return np.minimum(np.minimum(one, two), NO_TOKEN)

    def encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none empty), one after the other, and where each piece begins and the last one ends.

        In each round every piece that still can puts together its leftmost pair of least rank, so a round costs some
        passes over the pieces that are not done; pieces of LONG bytes and more are merged by a heap, in n log n steps.
        """
        sizes = np.array([len(p) for p in pieces], np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        for i in np.flatnonzero(sizes >= LONG):
            found[i] = self._merged(pieces[i])
        which = np.flatnonzero(sizes < LONG)
        ids = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in which]), np.uint8)]
        sizes = sizes[which]
        near = self._neighbours(ids, np.cumsum(sizes) - 1)
        while len(which):
            first = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(near, first)
            open_ = least < NO_TOKEN
            if not open_.all():
                for i, a, n in zip(which[~open_].tolist(), first[~open_].tolist(), sizes[~open_].tolist(), strict=True):
                    found[i] = ids[a : a + n]
                stay = np.repeat(open_, sizes)
                ids, near, which, least, sizes = ids[stay], near[stay], which[open_], least[open_], sizes[open_]
                continue
            hits = np.flatnonzero(near == np.repeat(least, sizes))
            of = np.searchsorted(first, hits, "right") - 1
            at = hits[np.flatnonzero(np.diff(of, prepend=-1))]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids[at] = least
            ids, near, sizes = ids[stay], near[stay], sizes - 1
            at = at - np.arange(len(at))
            first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
            ahead, behind = at[at < last], at[at > first]
            near[at] = NO_TOKEN
            near[ahead] = self.rank(ids[ahead], ids[ahead + 1])
            near[behind - 1] = self.rank(ids[behind - 1], ids[behind])
        return np.concatenate(found) if found else ids, np.cumsum([0, *map(len, found)])

    def _neighbours(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of each id and the next one, NO_TOKEN for the last ones of pieces."""
        near = np.full(len(ids), NO_TOKEN, np.int64)
        if len(ids) > 1:
            near[:-1] = self.rank(ids[:-1], ids[1:])
        near[last] = NO_TOKEN
        return near

    def _merged(self, piece: bytes) -> np.ndarray:
        """Ids of one piece: a heap of ranks and places, entries that no longer hold are passed over."""
        start = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(start)
        near = self._neighbours(start, np.array([n - 1])).tolist()
        ids, after, before = start.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i) for i, r in enumerate(near) if r < NO_TOKEN]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if near[i] != r:
                continue
            gone = after[i]
            ids[i], near[gone], after[i] = r, NO_TOKEN, after[gone]
            ids[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0:
                    near[left] = self.ranks.get(self.tokens[ids[left]] + self.tokens[ids[right]], NO_TOKEN) if right < n else NO_TOKEN
                    if near[left] < NO_TOKEN:
                        heapq.heappush(heap, (near[left], left))
        return np.array([x for x in ids if x >= 0], np.int64)


def _places(left, right):
    """Two cells for a pair of ids; for numbers and arrays alike."""
    return (left * 31_337 + right * 7_919) % CELLS, (left * 10_007 + right * 40_009) % CELLS


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row or element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def chunk_counts(docs: DataFrame) -> DataFrame:
    """chunk (without its space), n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for text in _strings(batch["text"]):
                found.update(text.split(" ")[1:])
                if len(found) > COUNTED:
                    yield given()
                    found.clear()
        if found:
            yield given()

    return docs.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The frequent chunks, by a threshold on the count that leaves at most so many."""
    level = F.floor(F.log2("n") * 8)
    left, least = most, None
    # some hundred rows: one per eighth of a doubling
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    return counts.where(level >= least) if least is not None else counts.limit(0)


class _Splitter:
    """Chunks to packed ids; pieces that are no token stand as -1, -2, ... and are listed once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.find, self.ranks = vocabulary, regex.compile(vocabulary.pattern).findall, vocabulary.ranks
        self.open: dict[bytes, int] = {}

    def __call__(self, text: str) -> bytes:
        ids = []
        for piece in self.find(text):
            piece = piece.encode()
            rank = self.ranks.get(piece)
            ids.append(self.open.setdefault(piece, ~len(self.open)) if rank is None else rank)
        return np.array(ids, np.int32).tobytes()

    def filled(self, texts: list[bytes]) -> pa.ListArray:
        """The ids of each text, its open pieces merged; the list of open pieces begins anew."""
        ids, sizes = np.frombuffer(b"".join(texts), np.int32), np.array([len(t) // 4 for t in texts], np.int64)
        own, cuts = self.vocabulary.encoded([*self.open])
        self.open = {}
        there = ids < 0
        place = ~ids[there]
        width = np.ones(len(ids), np.int64)
        width[there] = cuts[place + 1] - cuts[place]
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(ids, width)
        n = width[there]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(ends[:-1][there], n) + within] = own[np.repeat(cuts[place], n) + within]
        return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(sizes)])], pa.int32()), pa.array(out, pa.int32()))


def _split(vocabulary: Vocabulary, column: str, kind: pa.DataType, lookup: dict[str, bytes] | None):
    """A task that gives key and ids of rows; without a lookup the column holds single chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _Splitter(vocabulary)

        def text_ids(text: str) -> bytes:
            if lookup is None:
                return split(" " + text)
            if LOOSE.search(text):
                return split(text)
            first, *rest = text.split(" ")
            return b"".join([split(first), *[lookup.get(c) or split(" " + c) for c in rest]])

        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(low, TOGETHER)
                ids = split.filled([text_ids(text) for text in _strings(part[column])])
                yield pa.RecordBatch.from_arrays([part[0].cast(kind), ids], names=["key", "ids"])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, ids (array<int>) of each row of docs: every match of the pattern is encoded by itself.

    Null and empty texts have no ids. Rows that repeat are encoded each; null ids stay; other columns are not looked
    at. ``dictionary`` bounds what is sent to the tasks and has no influence on the result. A piece of n bytes is merged
    in time n log n, once for each some hundred texts that hold it.
    """
    spark = docs.sparkSession
    vocabulary.cells, vocabulary.byte_ids  # noqa: B018  made once, here
    sent_vocabulary = spark.sparkContext.broadcast(vocabulary)

    def later(column: str, kind: pa.DataType, lookup):
        def run(batches):
            return _split(sent_vocabulary.value, column, kind, lookup.value if lookup else None)(batches)

        return run

    frequent = most_frequent(stored(chunk_counts(docs)), dictionary).select("chunk")
    known = frequent.mapInArrow(later("chunk", pa.string(), None), "key string, ids array<int>").toArrow()
    ids = known["ids"].combine_chunks()
    cuts, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype(np.int32)
    lookup = {c: values[a:b].tobytes() for c, a, b in zip(known["key"].to_pylist(), cuts, cuts[1:], strict=False)}
    sent = spark.sparkContext.broadcast(lookup)
    return docs.select("doc_id", "text").mapInArrow(later("text", pa.int64(), sent), "key long, ids array<int>").withColumnRenamed("key", "doc_id")


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with a binary column of the tokens' bytes put together; null ids give null, no ids no bytes. Ids outside
    the vocabulary fail."""
    hexed = pa.table({"tokens": pa.array([[t.hex() for t in vocabulary.tokens]], pa.list_(pa.string()))})
    names = rows.columns
    rows = rows.withColumn("_tokens", rows.sparkSession.createDataFrame(hexed).scalar())
    joined = _let(F.col("_tokens"), lambda t: F.array_join(F.transform(ids, lambda i: F.element_at(t, i + 1)), ""))
    return rows.select(*names, F.unhex(joined).alias(into))
