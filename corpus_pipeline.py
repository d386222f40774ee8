"""A training corpus from documents: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on, with the columns of documents; the last
one returns doc_id and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import bpe, decontaminate, jaccard, pii, quality
from docketry.llm.common import stored, table
from docketry.llm.queries import GOOD_FROM, vocabulary

#: The rows of run() come from fitted classifiers and a tokenizer, which SQL cannot tell.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least GOOD_FROM; learnt from the labels of those that are here.

    Null and empty texts score as texts without words; repeated rows get one score. Without labels here all scores are
    a half, so all documents stay. Other columns pass through, whatever their names. The statistics that the fit reads
    three times are stored.
    """
    described = stored(quality.described(docs.select("doc_id", "text")))
    model = quality.fit(described, table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(quality.score(model, F.col("text")) >= GOOD_FROM)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Texts without words are in no group. Of rows that repeat one doc_id all stay or go; rows without an id stay.
    """
    return jaccard.one_per_group(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Rows without an id stay; of rows that share one all stay or go."""
    leaks = decontaminate.find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars counts the characters of the new text.

    Null texts stay null and their n_chars as it was. All columns travel in one, so none of them can clash.
    """
    found = pii.find(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    found = found.select("row", pii.redacted(F.col("text"), F.col("spans")).alias("redacted"))
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("redacted").cast("long"), F.col("row.n_chars"))
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each row; null and empty texts have none. Other columns go."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_pii),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

