"""One query per operator over its whole tables, with production parameters, and DuckDB SQL where it can tell the rows."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontaminate, embeddings, jaccard, licenses, lm, pii, quality, substrings, toxicity, whitening
from .common import remainder, stored, table

RANKS = "byte_bpe_multi_50k.tiktoken"
TOXIC_FROM, GOOD_FROM = 0.7, 0.3
#: Centroids and rounds of op11; the conversation op12 adds, which holds the template's own marks.
CENTROIDS, ROUNDS = 40, 5
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def vocabulary(path: str | None = None) -> bpe.Vocabulary:
    return bpe.Vocabulary(path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text and their bytes put together again."""
    known = vocabulary()
    rows = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), known), known)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _held_out(n: int, k: int):
    return F.coalesce(remainder(F.col("doc_id"), n) == k, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(3, 1))
    return toxicity.score_texts(docs.select("doc_id", _held_out(3, 1).alias("held_out"), "text"), model, TOXIC_FROM).drop("text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = stored(quality.described(table(spark, sf_dir, "documents").select("doc_id", "text")))
    model = quality.fit(described, table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    return quality.score_texts(described.withColumn("held_out", _held_out(5, 0)), model, GOOD_FROM)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.drop_repeats(table(spark, sf_dir, "documents"), 35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), _held_out(7, 2))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", *(_count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)),
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


def _count(kind: int):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    found = clustering.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, order)
    # a row for each centroid
    sums = {r["cluster"]: r["n"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    total = sum(sums.values())
    told = spark.createDataFrame([(c, sums.get(c, 0), total, h) for c, h in enumerate(hashes)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    log = chat.log_of(table(spark, sf_dir, "conversations").select(*planted.columns).union(planted))
    return chat.digests(stored(chat.rendered(log)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_toxicity, op3_quality, op4_licenses, op5_substrings, op6_lm_scores, op7_embeddings, op8_jaccard, op9_pii,
        op10_decontaminate, op11_centroids, op12_chat, op13_whitening,
    )
}

#: Smallest node reachable, for a table links (a, b) in both directions and a table nodes (id).
_REACHED = """reached AS (
  SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b AS other FROM reached r JOIN links l ON l.a = r.other
)"""

def _kmeans_sql() -> str:
    """Lloyd's rounds as common table expressions: distance and number of a centroid in one number, so the least is both."""
    steps = [
        r"""v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
)""",
        f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('2:' || vec_id), x LIMIT {CENTROIDS}
)""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS (
  SELECT id, any_value(vec_id) AS vec_id, any_value(v.x) AS x,
    min(list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {CENTROIDS} + c) AS m FROM v, c{r} k GROUP BY id
)""")
        if r < ROUNDS:
            steps.append(f"""n{r} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM (
    SELECT m % {CENTROIDS} AS c, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS d(j) GROUP BY 1, 2) GROUP BY c
), c{r + 1} AS (SELECT k.c, coalesce(n.x, k.x) AS x FROM c{r} k LEFT JOIN n{r} n ON n.c = k.c)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, (m % {CENTROIDS})::INTEGER AS cluster, m // {CENTROIDS} AS distance, sum(m // {CENTROIDS}) OVER (PARTITION BY m % {CENTROIDS})::BIGINT AS cluster_inertia,
  sum(m // {CENTROIDS}) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} k ON k.c = m % {CENTROIDS}"""


def _chat_sql() -> str:
    """Marks around a message have a length by its role; each control string and each backslash costs one character more."""
    rows = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PLANTED)
    controls = ("\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE ", "<</ROLE>>")
    more = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in controls)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {rows})
), s AS (
  SELECT *, length(text) + {more} + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 5 WHEN 'system' THEN 15 ELSE 18 + length(url_encode(role)) END AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


ORACLES = {
    "op11_centroids": _kmeans_sql(),
    "op12_chat": _chat_sql(),
    "op5_substrings": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 33, 1))) AS i FROM w WHERE len(words) >= 35
), runs AS (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS run FROM places
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY run) AS n FROM runs) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM repeated, range(0, 35) AS r(j)
), each AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), kept AS (
  SELECT e.doc_id, count(g.i) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)""",
    "op7_embeddings": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(other) AS component_id, min(other) = id AS kept
FROM reached GROUP BY id""",
    "op8_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), nodes AS (SELECT doc_id AS id FROM documents), {_REACHED}
SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN n ON n.doc_id = id GROUP BY id""",
}
