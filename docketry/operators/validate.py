"""Request checks as columns: normalised value and reason for refusal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import strip


def county_name(col: Column) -> Column:
    return F.replace(strip(F.lower(col)), F.lit(" "), F.lit("_"))


def document_type(col: Column) -> Column:
    return strip(F.lower(col))


def _missing(col: Column) -> Column:
    return col.isNull() | (F.length(col) < 1)


def valid_mongo_id(col: Column) -> Column:
    """NULL is fine; otherwise exactly 24 hexadecimal digits."""
    return col.isNull() | F.rlike(col, F.lit(r"^[0-9a-fA-F]{%d}\z" % V.CATALOG_ID_LENGTH))


def check_batch_requests(requests: DataFrame) -> DataFrame:
    """Normalise batch requests; ``reject_reason`` is NULL for good ones."""
    reason = (
        F.when(_missing(F.col("county_name")), F.lit("county_name is empty"))
        .when(_missing(F.col("document_type")), F.lit("document_type is empty"))
        .when(F.col("date_to").isNull(), F.lit("date_to is missing"))
        .when(F.col("date_from") > F.col("date_to"), F.lit("date_from must be before date_to"))
    )
    return requests.withColumn("reject_reason", reason).withColumns(
        {
            "county_name": county_name(F.col("county_name")),
            "document_type": document_type(F.col("document_type")),
        }
    )


def check_document_requests(requests: DataFrame) -> DataFrame:
    """Normalise single-document requests; ``reject_reason`` is NULL for good ones."""
    mongo = F.col("mongo_id")
    path = strip(F.col("doc_path"))
    reason = (
        F.when(F.col("case_id").isNull(), F.lit("case_id is missing"))
        .when(
            mongo.isNotNull() & (F.length(mongo) != V.CATALOG_ID_LENGTH),
            F.lit("mongo_id must be a 24-character hex string"),
        )
        .when(~valid_mongo_id(mongo), F.lit("mongo_id must be a valid ObjectId hex string"))
        .when(_missing(path), F.lit("doc_path cannot be empty"))
        .when(_missing(F.col("document_description")), F.lit("document_description is empty"))
    )
    return requests.withColumn("reject_reason", reason).withColumns(
        {"case_id": F.col("case_id").cast("string"), "doc_path": path}
    )
