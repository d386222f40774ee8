"""The operators against brute force, on odd rows and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from docketry.llm import bpe, components, decontaminate, embeddings, jaccard, licenses, lm, pii, quality, substrings, toxicity
from docketry.llm.common import remainder
from docketry.llm.queries import ORACLES, QUERIES, vocabulary
from docketry.registry.compare import connect, differences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == []


@pytest.mark.parametrize("dictionary", [0, 500])
def test_bpe_is_tiktoken(spark, odd, dictionary):
    known = vocabulary()
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    texts = [None, "", " ", "a   b", " a\n b \n c", "\n \n", "it's  I'LL 12345678901", "日本 𝒳 😀 a　b  c", "\x1c d a", "q" * 200, "ÿ\x00", "<|endoftext|> unheard"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").union(odd.where("doc_id < 9 or doc_id is null").select("doc_id", "text"))
    got = sorted((tuple(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(docs, known, dictionary), known).collect())
    want = sorted((tuple(coder.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert got == want


def test_bpe_merges_pieces_together_and_long_ones_fast(spark, odd):
    known = vocabulary()
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})
    rng = np.random.default_rng(1)
    letters = [bytes(rng.choice([*b"abcdeinorst"], n).astype(np.uint8)) for n in [*range(1, 150), 40_000] for _ in range(3 if n < 150 else 1)]
    pieces = [*letters, b"a" * 63, b"a" * 64, b"a" * 20_001, b"ab" * 40, "\u00e9".encode() * 500, bytes(range(256)) * 2, b"\xff"]
    ids, cuts = known.encoded(pieces)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [coder._encode_single_piece(p) for p in pieces]
    assert known.encoded([])[1].tolist() == [0]
    # whole texts go through no lambda of Spark's
    encoded = bpe.encode(odd.where("doc_id > 9"), known, 0)
    assert "lambda" not in encoded._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {r.doc_id: coder.encode_ordinary(r.text) for r in odd.where("doc_id > 9").collect()}


def test_bpe_of_no_rows(none):
    assert bpe.encode(none, vocabulary()).count() == 0


def test_substrings(odd, none):
    rows = odd.collect()
    seen = Counter(tuple(w[i : i + 35]) for r in rows if (w := words(r.text)) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = words(r.text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r.doc_id or -1, " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    got = [(r.doc_id or -1, r.text, r.n_words, r.n_removed) for r in substrings.drop_repeats(odd).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.drop_repeats(none).count() == 0


def test_jaccard_groups(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 3, 5), (None, 3, 5), (6, 4, 6), (7, 56, 7), (8, 58, 7), (9, 1, 9)} <= got
    assert jaccard.similar_groups(none).count() == 0
    assert jaccard.one_per_group(odd).count() == odd.count() - 1


def test_jaccard_chains(spark):
    """Copies with growing edits: links lead from one end to the other, though the ends are not similar."""
    base, rows = [f"t{i}" for i in range(80)], []
    for n in range(12):
        rows.append((n, " ".join([f"u{i}" for i in range(n)] + base[n:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.similar_groups(docs).collect()} == {0}


def test_jaccard_edits_of_one_text(spark):
    """Weak and strong edits of one text: some link with it, some with one another alone, some with nothing."""
    rng, base, rows = np.random.default_rng(5), [f"t{i}" for i in range(120)], []
    for n in range(120):
        w = list(base)
        for p in rng.choice(120, n % 12, replace=False):
            w[p] = f"new{rng.integers(40)}"
        rows.append((n, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
    comp = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = [low if c == high else c for c in comp]
    assert 2 < len(set(comp)) < 120
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 50), (40, 41), (41, 40), (41, 40)], "a long, b long")
    got = {(r.node, r.component) for r in components.components(edges).collect()}
    assert got == {(i, 0) for i in range(21)} | {(40, 40), (41, 40)}
    assert components.components(edges.limit(0)).count() == 0


def test_lm_scores(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", "text").union(odd.select("doc_id", "text")).cache()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs.collect() if r.doc_id is not None}
    counts = Counter(w for r in docs.collect() if not held.get(r.doc_id) for w in [*words((r.text or "").translate(LOWER)), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (r.doc_id or -1, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4))
        for r in docs.collect() if (w := [*words((r.text or "").translate(LOWER)), None])
    )
    rows = lm.score_texts(docs, remainder(F.col("doc_id"), 7) == 2).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    held_rows = [r for r in rows if r.held_out]
    assert all(r.score < 0 for r in rows) and sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)
    assert lm.score_texts(none, F.lit(False)).count() == 0


def test_em_weights_add_up():
    cells = {"bucket": np.array([0, 1, 1]), "n": np.array([5, 5, 5]), "p2": np.array([0, 0.5, 0]), "p1": np.array([0.1, 0.01, 0.2])}
    w = lm.learn_weights(cells, 10)
    assert np.allclose(w.sum(1), 1) and w[1, 0] > w[0, 0]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.vstack([base, base[:20] + rng.normal(size=(20, 16)) * 0.12, base[:5], base[:5]])
    rows = [(i, e.tolist()) for i, e in enumerate(x.astype(np.float32))] + [
        (100, None), (101, [0.0] * 16), (102, [None] + [1.0] * 15), (103, [math.nan] + [1.0] * 15), (104, [math.inf] + [1.0] * 15), (105, []), (106, [1.0, 2.0]), (None, [1.0, 2.0]),
    ]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("class", F.lit("clash"))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    like = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    comp = np.arange(len(u))
    while (before := comp.copy()) is not None:
        for a, b in zip(*np.nonzero(like), strict=True):
            comp[a] = min(comp[a], comp[b])
        if (before == comp).all():
            break
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(d, cell=16).collect()}
    assert {i: got[i] for i in range(len(u))} == {i: (like[i].sum(), comp[i], comp[i] == i) for i in range(len(u))}
    assert all(got[i] == (0, i, True) for i in range(100, 106)) and got[106] == (1, 106, True) and got[None] == (1, 106, False)
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_embeddings_in_small_blocks(spark, monkeypatch):
    """A large group of near copies, spread over several blocks of its cell, has all its links."""
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "OTHERS", 16)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=16) + rng.normal(size=(70, 16)) * 0.15, rng.normal(size=(60, 16))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    d = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.n_links for r in embeddings.near_duplicates(d, cell=32).collect()} == dict(enumerate(links.tolist()))


def test_leaks(spark, odd, none):
    items = [(1, "The quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (4, "one"), (5, " ".join(f"w{i}" for i in range(30)))]
    texts = [(20, "x y z the quick brown fox jumped over the lazy dog and runs away now"), (21, "the quick fox"), (22, None)]
    known = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = {(r.doc_id, r.item_id, r.start, r.edits) for r in decontaminate.find_leaks(docs, known).collect()}
    assert got == {(20, 1, 3, 1), (4, 4, 0, 0), (7, 5, 0, 0), (8, 5, 1, 0)}
    assert decontaminate.find_leaks(none, known).count() == 0 and decontaminate.find_leaks(docs, known.limit(0)).count() == 0


def test_recall_of_walks():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 2000, 40))) for i in range(40)]
    index = decontaminate.Index(items, 0.2, decontaminate.WALKS, decontaminate.TABLES, decontaminate.PLACES)
    found = 0
    for n in range(200):
        y = list(index.items[n % 40])
        for _ in range(int(rng.integers(0, 5))):
            p = int(rng.integers(len(y)))
            y = y[:p] + [np.uint64(rng.integers(1 << 60))] + y[p + int(rng.integers(2)) :]
        y = np.array((y + [np.uint64(7)])[:40], np.uint64)[None]
        near = decontaminate.edit_distance(index.items[n % 40], y, 8)[0] <= 8
        found += not near or any(i == n % 40 for _, i, _ in index._near(y, 40, 8))
    assert found >= 190


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"v{x}" for x in rng.integers(0, 1000, 12 + i % 5))) for i in range(30)] + [(30, None), (3, "same id here")]
    docs = spark.createDataFrame([(i, f"a {x} b") for i, x in items], "doc_id long, text string")
    known = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    whole = Counter(tuple(r) for r in decontaminate.find_leaks(docs, known).collect())
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 500)
    assert sum(whole.values()) >= 32 and Counter(tuple(r) for r in decontaminate.find_leaks(docs, known).collect()) == whole


@pytest.mark.parametrize("size", [15, 40, 59, 100, 200, 400])
def test_recall_at_most_edits(size):
    rng, most = np.random.default_rng(size), size // 5
    items = [(i, [f"v{x}" for x in rng.integers(0, 100_000, size)]) for i in range(60)]
    index = decontaminate.Index([(i, " ".join(x)) for i, x in items], 0.2, decontaminate.WALKS, decontaminate.TABLES, decontaminate.PLACES)
    texts = []
    for _, x in items:
        x = list(x)
        for k, p in enumerate(rng.choice(size, most, replace=False)):
            x[p] = f"e{k}"
        texts.append(" ".join(["before", *x, "after"]))
    found = {t for t, i, start, n in index.find(pa.array(texts)) if t == i}
    print(f"recall at {size} words: {len(found) / 60:.3f}, tables and places {index.plans[size]}")
    assert len(found) >= 0.9 * 60


def test_licenses(spark, odd, none):
    known = licenses.templates(spark)
    texts = [(30, "Intro. Released under the MIT License. End"), (31, "x " * 500 + licenses.TEMPLATES[5][1].upper()), (32, "the license is lost"), (33, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").union(odd.select("doc_id", "text"))
    got = {(r.doc_id, r.template_id) for r in licenses.scan(docs, known).collect()}
    assert got == {(30, 0), (31, 5)}
    assert licenses.scan(none, known).count() == 0 and licenses.scan(docs, known.limit(0)).count() == 0


def _luhn(d):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and _luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii(spark, odd, none):
    texts = [
        "a@b.c_d@e.f.g", "x@y@z.com 1.2.3.4.5.6.7.8", "1.2.3.256 001.2.3.4", "+1 (017) 555-7713 4111 1111 1111 1111 é4111-1111-1111-1111", "4" * 3000, "1 " * 3000,
        "a." * 500 + "@" + "b." * 500 + "c", "ü@x.de ü+123456789012 😀 8.8.8.8", "4952935900253052 +1+2",
    ]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").union(odd.select("doc_id", "text")).withColumn("spans", F.lit(1))
    for r in pii.find(docs).withColumn("red", pii.redacted(F.col("text"), F.col("spans"))).collect():
        want = _base(r.text or "")
        assert [tuple(s) for s in r.base] == want and set(want) <= {tuple(s) for s in r.spans}
        if r.text and len(want) == 1 == len(r.spans):
            a, k, b = want[0]
            assert r.red == f"{r.text[:a]}[{pii.KINDS[k]}]{r.text[b:]}"
    assert pii.find(none).count() == 0


def _card(rng, n):
    head = "4" + "".join(map(str, rng.integers(0, 10, n - 2)))
    return head + next(c for c in "0123456789" if _luhn(head + c))


def test_pii_loose(spark):
    rng = np.random.default_rng(3)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    texts = []
    for i in range(60):
        ip = ".".join(map(str, rng.integers(0, 256, 4)))
        texts.append(f"see na{i}.x{i}@host{i}.example.org and {ip} or {_card(rng, 16)} then +1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)} end {number(11)} of")
    card, short = _card(rng, 16), _card(rng, 13)
    wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
    planted = [
        ("email", "jane.roe (at) mail (dot) org"), ("email", "jane.roe (at) mail dot org"), ("email", "jane at mail dot org"), ("email", "jane[at]mail[dot]org"),
        ("phone", "0044 207 555 1234"), ("phone", "1-743-555-3824"), ("phone", "(743) 555-3824"), ("card", re.sub("(....)(?=.)", r"\1.", card)), ("card", short), ("ip", "10,200,30,7"),
    ]
    plain = ["20240117", "83650174629", "1,234,567,890", "noon @ home. Then", re.sub("(....)(?=.)", r"\1.", wrong), "12.05.2024"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"so it was {x} here") for i, (_, x) in enumerate(planted)] + [(200 + i, f"so it was {x} here") for i, x in enumerate(plain)]
    got = {r.doc_id: {(pii.KINDS[k], r.text[a:b]) for a, k, b in r.spans} for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [x for i, x in enumerate(planted) if x not in got[100 + i]] == []
    assert [(x, got[200 + i]) for i, x in enumerate(plain) if got[200 + i]] == []


def test_classifiers(spark, sf, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    rows = toxicity.score_texts(docs, model, 0.7).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in toxicity.score_texts(odd, model, 0.7).collect()) and toxicity.score_texts(none, model, 0.7).count() == 0
    model = quality.fit(quality.described(docs), labels, remainder(F.col("doc_id"), 5) != 0)
    rows = quality.score_texts(docs, model, 0.3).join(labels, "doc_id").where(remainder(F.col("doc_id"), 5) == 0).collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in quality.score_texts(odd, model, 0.3).collect()) and quality.score_texts(none, model, 0.3).count() == 0
    empty = labels.limit(0)
    assert toxicity.fit(docs, empty, F.lit(True)).score(["a"])[0] == 0.5
    assert quality.fit(quality.described(docs), empty, F.lit(True)).score(np.zeros((1, len(quality.STATISTICS))))[0] == 0.5


def test_isotonic():
    assert quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == [0.1, 0.4, 0.4, 0.9]


def test_pipeline(spark, sf):
    import corpus_pipeline

    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0 < len(got) < len(docs) and all(len(x) > 0 for x in got.values())
    assert len({hashlib.sha256((docs[i] or "").encode()).hexdigest() for i in got}) == len(got)


def test_trees_learn_from_all_base_spans(spark):
    docs = spark.createDataFrame([(i, f"mail me at person{i}@example.org now") for i in range(300)], "doc_id long, text string")
    texts = docs.select(F.xxhash64("text").alias("key"), "text", pii.base_spans(F.col("text")).alias("base"))
    rows = pii.candidates(texts)
    assert rows.where("label = 1").count() == 300
    assert pii.examples(rows).select("key", "start").distinct().count() == 300
