"""What the operators share: scratch tables, folds by checksum, sizes."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of one block of documents; a task holds one block with some ten arrays of its words.
BLOCK_BYTES = 12 << 20


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which all executors share; a temporary folder only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docketry-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written as Parquet below the scratch path and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """name, or name behind underscores, so that no column (case ignored) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def n_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks follow the bytes of text, with one per shuffle partition at least."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(text_bytes(docs) / block_bytes))


def in_blocks(docs: DataFrame, blocks: int, *columns: Column) -> DataFrame:
    """doc_id, text (null: null) and the block a row belongs to: by a hash, so no id, source or text is favoured."""
    return docs.select(
        "doc_id", "text", *columns,
        F.pmod(F.xxhash64("doc_id", F.octet_length("text"), "text"), F.lit(blocks)).alias("block"),
    )


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, bound: int | None = None) -> DataFrame:
    """doc_id and label of rows to learn from: labels that are 0 or 1; with a bound, that many of the smallest
    hashed ids. Repeated labels of one id count once: the larger."""
    out = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    )
    if bound is None:
        return out
    return out.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
