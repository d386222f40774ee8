"""N-gram Jaccard join by set relations, exact, in blocks.

1. Identical sets make one class; only one set of a class goes on.
2. Shingles are counted everywhere (tally). Each set orders its shingles by (count, hash), the rare ones first. A pair
   with similarity t shares a shingle among the first n - ceil(t n) + 1 of either set (prefix filter); shingles that
   one class alone has need no list.
3. Index lists: the classes with one shingle in the prefix, ordered by the place of the shingle there. A set with few
   shingles of its own, such as the text that others are edits of, has the shared ones at early places and comes first.
4. Lists are read in rounds of blocks of heads, each four times as long as the one before; the members behind a head are
   compared with it, but only those that size, place and the shingles no other set has allow, and only those not yet in the head's component. So the
   answers of a set serve all sets found to be similar to it, a list whose members are all in one component is
   skipped whole, and yet no link between different components is missed: in the end each pair of a list has been
   compared or is known to be connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tally
from .common import in_blocks, n_blocks, stored
from .components import components
from .words import P, mix, slices, windows, words

DOC, LIST, SET = 0, 1, 2
FOUND = "kind int, doc_id long, class long, n int, token long, place int, own int, shingles binary"
FOUND_ARROW = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("token", pa.int64()),
     ("place", pa.int32()), ("own", pa.int32()), ("shingles", pa.binary())]
)
HEADS, GROWTH = 4, 4


def shingle_sets(texts: pa.ChunkedArray, k: int):
    """Per text, in order: the sorted distinct hashes of its k-word shingles, or of all words if there are fewer."""
    for _, _, raw, at in slices(texts):
        hashes, _, _, first = words(raw, at, lower=True)
        full = windows(hashes, k)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(full[a : b - k + 1]) if b - a >= k else windows(hashes[a:b], b - a) if b > a else full[:0]


def class_of(shingles: np.ndarray) -> int:
    """64 bits that stand for a set of hashes."""
    with np.errstate(over="ignore"):
        parts = np.array([shingles.sum(dtype=np.uint64) * P + np.uint64(len(shingles)), np.bitwise_xor.reduce(mix(shingles))], np.uint64)
        return int(mix(np.array([mix(parts[:1])[0] ^ parts[1]], np.uint64)).view(np.int64)[0])


def rank_code(total: np.ndarray) -> np.ndarray:
    """Counts up to 200 as they are, larger ones by their logarithm; a byte, never falling with the count."""
    return np.where(total <= 200, total, np.minimum(255, 200 + 4 * np.log2(np.maximum(total, 1) / 200))).astype(np.uint8)


def _fewest(n, percent: int):
    """Smallest intersection that a set of n has with any similar one."""
    return (percent * n + 99) // 100


def _similar(percent: int):
    def verify(batches):
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t["x"], t["y"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield t.select(["a", "b"]).filter(pa.array(keep))

    return verify


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose sets are similar."""
    x = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_similar(percent), "a long, b long")


def _found(kind: int, rows: int, columns: dict) -> pa.Table:
    """Rows of one kind; columns that are not given are null."""
    given = columns | {"kind": np.full(rows, kind, np.int32)}
    return pa.Table.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in FOUND_ARROW], schema=FOUND_ARROW)


def _index(docs: DataFrame, k: int, percent: int, blocks: int) -> DataFrame:
    """Rows of three kinds: documents with class and size, list entries, sets that are in a list."""
    d = in_blocks(docs, blocks)

    def classes(t: pa.Table) -> pa.Table:
        sets = [(class_of(s), len(s)) if len(s) else (None, 0) for s in shingle_sets(t["text"], k)]
        return pa.table({"block": t["block"], "class": pa.array([c for c, _ in sets], pa.int64())})

    per_block = (
        d.groupBy("block").applyInArrow(classes, "block long, class long").where("class is not null").distinct()
    )
    home = per_block.groupBy("class").agg(F.min("block").alias("home"), F.count("*").alias("n")).where("n > 1")
    elsewhere = per_block.join(home, "class").where("block <> home").select(
        "block", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("boolean").alias("wide"), F.lit(None).cast("binary").alias("found"), "class"
    )

    def own(t: pa.Table, told: pa.Table):
        """doc_id, set, class, whether it stands for its class; for each text."""
        seen = set(told["class"].drop_null().to_pylist())
        for doc_id, s in zip(t["doc_id"].to_pylist(), shingle_sets(t["text"], k), strict=True):
            c = class_of(s) if len(s) else None
            yield doc_id, s, c, c is not None and c not in seen
            seen.add(c)

    def ask(t: pa.Table, told: pa.Table) -> pa.Table:
        parts = [s for _, s, _, stands in own(t, told) if stands]
        if not parts:
            return tally.REQUEST_ARROW.empty_table()
        found, counts = tally.by_shard(np.concatenate(parts), blocks, wide=False)
        return tally.request(t["block"][0].as_py(), found, counts, blocks, wide=False)

    def index(t: pa.Table, told: pa.Table) -> pa.Table:
        every = list(own(t, told))
        parts = [s for _, s, _, stands in every if stands]
        names = np.unique(tally.named(np.concatenate(parts) if parts else np.zeros(0, np.uint64), blocks))
        codes = tally.joined(told.filter(pa.compute.is_valid(told["wide"])), np.uint8, wide=False)
        lists, sets = [], []
        for _, s, c, stands in every:
            if not stands:
                continue
            n, code = len(s), codes[np.searchsorted(names, tally.named(s, blocks))]
            prefix = n - _fewest(n, percent) + 1
            alone = int((code == 1).sum())
            if alone >= prefix:
                continue
            order = np.lexsort((s, code))[:prefix]
            places = np.flatnonzero(code[order] > 1)
            lists.append((c, n, alone, s[order[places]].view(np.int64), places.astype(np.int32)))
            sets.append((c, n, s.tobytes()))
        lengths = [len(entries[3]) for entries in lists]
        # entries as arrays, a few bytes each: a tuple of numbers takes some hundred
        found = [
            _found(DOC, len(every), {"doc_id": [i for i, _, _, _ in every], "class": [c for _, _, c, _ in every], "n": [len(s) for _, s, _, _ in every]})
        ]
        if sets:
            classes_, sizes, alone, tokens, places = zip(*lists, strict=True)
            each = {"class": np.array(classes_, np.int64), "n": np.array(sizes, np.int32), "own": np.array(alone, np.int32)}
            entries = {name: np.repeat(values, lengths) for name, values in each.items()}
            found.append(_found(LIST, sum(lengths), entries | {"token": np.concatenate(tokens), "place": np.concatenate(places)}))
            found.append(_found(SET, len(sets), {"class": each["class"], "n": each["n"], "shingles": [x for _, _, x in sets]}))
        return pa.concat_tables(found)

    told = elsewhere
    asked = d.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask, tally.REQUEST)
    codes = tally.answered(asked, lambda keys, total: rank_code(total)).withColumn("class", F.lit(None).cast("long"))
    return d.groupBy("block").cogroup(told.unionByName(codes).groupBy("block")).applyInArrow(index, FOUND)


def _pairs(lists: DataFrame, of: DataFrame, first: int, last: int, percent: int) -> DataFrame:
    """a, b, shared: members b behind heads a number first to last - 1 of their lists, in another component than a."""
    in_list = Window.partitionBy("token").orderBy("place", "n", "class")
    now = (
        lists.join(of, lists["class"] == of["node"], "left")
        .select("token", "class", "n", "place", "own", F.coalesce("component", "class").alias("component"))
        .withColumn("least", F.min("component").over(Window.partitionBy("token")))
        .withColumn("most", F.max("component").over(Window.partitionBy("token")))
        .where("least < most").withColumn("at", F.row_number().over(in_list) - 1)
    )
    heads = now.where((F.col("at") >= first) & (F.col("at") < last)).select(
        "token", F.col("class").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("own").alias("oa"), F.col("component").alias("ca"), F.col("at").alias("ata")
    )
    need = F.ceil((F.col("na") + F.col("n")) * percent / (100.0 + percent) - 1e-6)
    # shingles that one set has alone stand first, and are in no intersection
    most = F.least(F.col("pa") - F.col("oa"), F.col("place") - F.col("own")) + 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("n") - F.col("place") - 1)
    return (
        now.join(heads, "token").where((F.col("at") > F.col("ata")) & (F.col("component") != F.col("ca")))
        .where((F.least("na", "n") * 100 >= F.greatest("na", "n") * percent) & (most >= need))
        .groupBy("a", F.col("class").alias("b")).agg(F.count("*").alias("shared"))
    )


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80, blocks: int | None = None) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of docs.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased. A set holds a text's distinct
    k-word shingles, or all its words as one shingle if there are fewer than k. Two sets link when
    100 * intersection >= percent * union. class_id is the smallest doc_id with the same set, component_id the
    smallest that links lead to. Without words (null or empty texts) the set is empty: n_shingles 0, both ids the row's
    own. Rows that repeat a doc_id are kept; a null doc_id counts in its group but names it only if there is no other.
    Sets are compared by 64-bit hashes of shingles.
    """
    found = stored(_index(docs, k, percent, blocks or n_blocks(docs)), "kind")
    rows = found.where(f"kind = {DOC}").select("doc_id", "n", "class")
    lists = found.where(f"kind = {LIST}").select("token", "class", "n", "place", "own")
    sets = found.where(f"kind = {SET}").select("class", "shingles")
    of = docs.sparkSession.createDataFrame([], "node long, component long")
    longest = lists.groupBy("token").count().agg(F.max("count")).first()[0] or 0

    links = None
    if longest > 1:
        # every member meets first that head with which it shares most shingles; most groups are settled by that
        best = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
        star = _pairs(lists, of, 0, 1, percent).withColumn("r", F.row_number().over(best)).where("r = 1").select("a", "b")
        links = stored(_links(star, sets, percent))
        of = components(links)
    first, last = 0, HEADS
    while first + 1 < longest:
        more = stored(_links(_pairs(lists, of, first, last, percent).select("a", "b"), sets, percent))
        if more.count():
            links = links.union(more)
            of = components(links)
        first, last = last, last * (1 + GROWTH)

    grouped = rows.join(of, rows["class"] == of["node"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "class", F.coalesce("component", "class").alias("component")
    )
    names = grouped.where("class is not null").groupBy("component", "class").agg(F.min("doc_id").alias("class_id"))
    names = names.join(names.groupBy("component").agg(F.min("class_id").alias("component_id")), "component").select("class", "class_id", "component_id")
    return grouped.join(names, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id names their component; of rows with that doc_id all stay. Null ids stay."""
    named = similar_groups(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(named, "doc_id", "left_anti")
