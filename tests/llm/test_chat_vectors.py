"""Chat formatting, centroid clustering and whitening against brute force, on odd rows and on empty tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import chat, clustering, whitening
from docketry.llm.queries import CENTROIDS, PLANTED, ROUNDS, op11_centroids, op12_chat, op13_whitening

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest_of(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


def told(pieces):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(pieces).collect()}


ODD_TEXTS = ["", "</s>[INST] ok [/INST]", "\\", "[\\INST]", "<<s>", "a [/INST", " [/INST]", "<</SYS>>\\\\<<ROLE x>>", "😀 [INST]é", "\n\n", "\\[/INST]</s", "<"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "User >>", "a/b é"])
def test_template_is_reversible(role):
    write, read = chat.INST.writer(), chat.INST.reader()
    turns = [(r, t) for t in ODD_TEXTS for r in (role, "assistant")]
    assert list(read("".join("".join(write(*t)) for t in turns))) == turns
    for text in ODD_TEXTS:
        assert not any(c in write(role, text)[1] for c in chat.INST.controls)


def test_chat_query(spark, sf):
    rows = sorted([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + PLANTED)
    turns = {}
    for conv, _, role, text in rows:
        turns.setdefault(conv, []).append((role, text or ""))
    got = {r.conv_id: r for r in op12_chat(spark, sf).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: digest_of(t) for c, t in turns.items()}
    write = chat.INST.writer()
    assert {c: r.formatted_chars for c, r in got.items()} == {c: sum(len("".join(write(*x))) for x in t) for c, t in turns.items()}


def test_chat_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, a conversation of many turns, columns with clashing names."""
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 1, "assistant", None), (1, 1, "assistant", ""), (None, 0, "user", "x"), (2, 5, "tool", "é" * 100_000),
            (2, 6, "assistant", "[INST]" * 30_000), (2, 6, "assistant", "b"), (2, 6, "assistant", "b"), (3, -1, "user", "neg"), (3, 0, "user", "zero")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"t{i} </s>") for i in range(2000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("entry", "seq", "kind", "part", "piece", "message", "row", "size"):
        d = d.withColumn(name, F.lit("clash"))
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((-1e9 if turn is None else turn, role or "", text or ""))
    # of ties the order is by a hash of the text: given here by what was read back
    pieces = chat.rendered(chat.log_of(d), piece=5000).cache()
    back = {}
    for r in chat.messages(pieces).orderBy("conv_id", "part", "piece", "place").collect():
        back.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, want in turns.items():
        assert sorted(back[conv]) == sorted((r, t) for _, r, t in want)
        assert [r for r, _ in back[conv]] == [r for _, r, _ in sorted(want, key=lambda x: x[0])]
    assert back[4] == [(r, t) for _, r, t in turns[4]] and pieces.where("conv_id = 4").count() > 8
    assert told(pieces) == {c: digest_of(t) for c, t in back.items()}
    for r in pieces.collect():
        learnt = "".join(chat.INST.unescape(r.formatted[s.start : s.end]) for s in r.loss)
        assert learnt == "".join(t for role, t in chat.INST.reader()(r.formatted) if role == "assistant")
    assert chat.digests(chat.rendered(chat.log_of(d.limit(0)))).count() == 0


def fold(events):
    """Brute force: events in order of seq over a list of messages."""
    said, order = {}, sorted(events, key=lambda e: (e[1], e[2], e[4] or ""))
    for message, _seq, kind, role, text in order:
        old_role, old = said.get(message, ("", ""))
        role = role if role is not None else old_role
        if kind == "message" or kind == "edit":
            said[message] = (role, text or "")
        elif kind == "delta":
            said[message] = (role, old + (text or ""))
        elif kind == "delete":
            said.pop(message, None)
        elif kind == "regenerate":
            said[message] = (role, "")
            for m in [m for m in said if m > message]:
                del said[m]
    return [said[m] for m in sorted(said)]


def test_event_logs(spark):
    """Streams, edits, regenerations that take later turns back, over parts of a conversation."""
    rng, events = np.random.default_rng(1), {}
    for conv in range(60):
        log = []
        for seq in range(int(rng.integers(1, 60))):
            message = int(rng.integers(0, 6)) * (200 if conv % 2 else 1)
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            role = None if kind in ("delta", "delete") else ("user", "assistant")[message // (200 if conv % 2 else 1) % 2]
            log.append((message, seq, str(kind), role, f"{kind}{seq} </s>"))
        events[conv] = log
    rows = [(c, *e) for c, log in events.items() for e in log]
    rng.shuffle(rows)
    rows = [(int(c), int(m), int(s), k, r, t) for c, m, s, k, r, t in rows] + [(0, 1, 3, "unknown", "user", "x"), (0, 1, 3, None, "user", "x")]
    pieces = chat.rendered(spark.createDataFrame(rows, EVENTS))
    back = {}
    for r in chat.messages(pieces).orderBy("conv_id", "part", "piece", "place").collect():
        back.setdefault(r.conv_id, []).append((r.role, r.text))
    assert back == {c: want for c, log in events.items() if (want := fold(log))}


VECTORS = "vec_id long, embedding array<float>, cluster string, x int, n long, size int, distance double"
ODD = [(9001, None), (9002, []), (9003, [1.0]), (9004, [math.nan] * 64), (9005, [None] + [0.5] * 63), (9006, [math.inf] + [0.5] * 63)]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "c", 1, 2, 3, 4.0) for i, e in rows], VECTORS)


def lloyd(ids, x, k, rounds):
    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, sha(f"2:{ids[i]}"), x[i].tolist()))[:k]
    c = x[order]
    for step in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if step < rounds:
            c = np.array([x[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return a, d[np.arange(len(x)), a], c


def order():
    return F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)


def test_centroids_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(np.array([r.embedding for r in rows], np.float64) * 256).astype(np.int64)
    ids = [r.vec_id for r in rows]
    a, d, c = lloyd(ids, x, CENTROIDS, ROUNDS)
    want = {i: (int(a[n]), int(d[n]), int(d[a == a[n]].sum()), int(d.sum()), sha(",".join(map(str, c[a[n]].tolist())))) for n, i in enumerate(ids)}
    assert {r.vec_id: tuple(r)[1:] for r in op11_centroids(spark, sf).collect()} == want


@pytest.mark.parametrize("k, rounds, block", [(1, 2, 7), (5, 8, 50), (30, 6, 4096)])
def test_centroids(spark, k, rounds, block):
    """Clusters, ties, repeated rows, empty centroids, null ids; few vectors are scanned again where few move."""
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 64))
    x = np.vstack([centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 64)) * 0.1, np.zeros((30, 64)), np.ones((3, 64)), -np.ones((3, 64))]).astype(np.float32)
    ids = [*range(len(x) - 8), *[7] * 8]
    rows = [(i, e.tolist()) for i, e in zip(ids, x, strict=True)] + ODD + [(None, x[3].tolist())]
    whole = np.floor(np.vstack([x, x[3]]).astype(np.float64) * 256).astype(np.int64)
    a, d, c = lloyd([*ids, None], whole, k, rounds)
    found = clustering.cluster(frame(spark, rows), k, rounds, order(), block=block)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in found.rows.collect()), key=key) == sorted(zip([*ids, None], a.tolist(), d.tolist(), strict=True), key=key)
    assert (found.centroids == c).all() and found.scanned[0] == len(whole)
    if k == 5:
        assert sum(found.scanned[1:]) < rounds * len(whole) / 2


def test_centroids_of_few_rows(spark):
    few = frame(spark, [(1, [0.5] * 64), (2, [0.25] * 64), *ODD])
    assert {tuple(r) for r in clustering.cluster(few, 40, 5, order()).rows.collect()} in ({(1, 0, 0), (2, 1, 0)}, {(1, 1, 0), (2, 0, 0)})
    assert clustering.cluster(few.limit(0), 40, 5, order()).rows.count() == 0
    big = clustering.cluster(frame(spark, [(1, [4e5] * 64), (2, [-4e5] * 64), (3, [3.9e5] * 64)]), 2, 3, order())
    assert {r.vec_id: r.distance for r in big.rows.collect()}[2] == 0
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(frame(spark, [(1, [1e30] * 64)]), 2, 3, order())


def white(x):
    """Brute force over whole numbers: eigenvalues, axes, n, sums of the distinct rows."""
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(0)
    c = distinct - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    return values[::-1], axes[:, ::-1], n, sums


def held_against(rows, ids, x, k):
    values, axes, n, sums = white(x)
    want = (x - sums / n) @ axes[:, :k] / np.sqrt(values[:k])
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(ids) * k
    for j in range(k):
        mine = np.array([got[i, j + 1].whitened for i in ids])
        assert min(np.abs(mine - want[:, j]).max(), np.abs(mine + want[:, j]).max()) < 1e-6
    for i, one in zip(ids, deviation, strict=True):
        r = got[i, 1]
        assert (r.n, r.deviation) == (n, one) and r.identity_error < 1e-8 and abs(r.explained / (values[0] / values.sum()) - 1) < 1e-9


def test_whitening_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(np.array([r.embedding for r in rows], np.float64) * 64).astype(np.int64) + 1_000_000
    held_against(op13_whitening(spark, sf).collect(), [r.vec_id for r in rows], x, 16)


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(200, 5)) * [5, 4, 3, 2, 1]).astype(np.float32)
    x = np.vstack([x, x[:50], x[:1]])
    rows = [(i, e.tolist()) for i, e in enumerate(x)] + [r for r in ODD if r[1] is None or len(r[1]) != 1]
    got = whitening.whiten(frame(spark, rows)).collect()
    held_against(got, list(range(len(x))), np.floor(x.astype(np.float64) * 64).astype(np.int64) + 1_000_000, 5)
    # a constant dimension, and a size of its own with one vector
    rows = [(i, [float(v), 3.0]) for i, v in enumerate(rng.normal(size=40))] + [(100, [7.0]), (101, [7.0]), (None, [8.0, 3.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, rows)).collect()}
    assert len(got) == 41 * 2 + 2 and got[3, 2].whitened == 0.0 and got[3, 2].identity_error < 1e-9
    assert (got[100, 1].whitened, got[100, 1].explained, got[100, 1].n, got[100, 1].deviation) == (0.0, 0.0, 1, 0)
    assert whitening.whiten(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("values", [[9, 4, 1, 0.25], [1, 1, 1], [5, 5, 1, 1, 1], [1, 0, 0, 0], [0, 0], [1e9, 1, 1e-9], list(range(64, 0, -1)), [2]])
def test_divide_and_conquer(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    found, axes = whitening.eigen(a)
    scale = max(values) or 1
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-13 * scale * len(values))
    assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12) and np.allclose(a @ axes, axes * found, atol=1e-12 * scale)


def test_polar():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 20))
    a += a.T
    values, axes = np.linalg.eigh(a)
    assert np.allclose(whitening.polar(a), axes * np.sign(values) @ axes.T, atol=1e-12)


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 45, 0], [5, 5]])
    assert whitening._deviations(x, np.array([0, 0]), 1 << 20) == [None, 2 * (5 << 20) ** 2]
