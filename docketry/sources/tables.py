"""Tables in: filings, page texts, catalog, file mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import parse_documents

MAPPING_ENTRY = "struct<doc_id:string,original_path:string,local_path:string>"


def is_pdf(name: Column) -> Column:
    """File names of filings; case matters."""
    return F.endswith(name, F.lit(".pdf"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def list_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes of the PDF files below a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.pdf")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.select("path", "length", "modificationTime")


def read_filings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Case catalog; a ``documents`` column of JSON text is decoded."""
    cases = spark.read.format(fmt).load(path)
    if dict(cases.dtypes).get("documents") == "string":
        cases = cases.withColumn("documents", parse_documents(F.col("documents")))
    return cases


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """File mapping ``{name: {doc_id, original_path, local_path}}`` from JSON files.

    Missing or unreadable input gives an empty mapping.
    """
    schema = "file_name string, doc_id string, original_path string, local_path string, seq long"
    try:
        whole = spark.read.text(path, wholetext=True)
    except Exception as problem:  # only a missing path counts as an empty mapping
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)
    return decode_mapping(whole, "value")


def decode_mapping(df: DataFrame, column: str) -> DataFrame:
    """Rows of a mapping from its JSON text; malformed text gives none."""
    entries = F.map_entries(F.from_json(F.col(column), f"map<string,{MAPPING_ENTRY}>"))
    rows = df.select(F.posexplode(entries).alias("seq", "entry"))
    return rows.select(
        F.col("entry.key").alias("file_name"), "entry.value.*", F.col("seq").cast("long").alias("seq")
    )
