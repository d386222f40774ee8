"""Filings, catalog, layout and request tables derived from the star-schema tables.

The driver tables hold no legal text, so every operator runs on text built from
orders, customers, suppliers and nations.  The SQL runs on Spark and on DuckDB.
``FIXTURES.md`` describes the eight variants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import let, strip

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _month_name(column: str) -> str:
    return (
        f"CASE month({column}) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March'"
        " WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July'"
        " WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October'"
        " WHEN 11 THEN 'November' ELSE 'December' END"
    )


FILINGS_CTE = f"""base AS (
  SELECT o.o_orderkey AS filing_id, o.o_orderkey % 8 AS variant,
         lower(n.n_name) || 'county' AS county,
         c.c_name AS plaintiff_name, s.s_name AS defendant_name,
         CAST(o.o_orderdate AS DATE) AS d1,
         CAST(o.o_orderdate + INTERVAL '5' DAY AS DATE) AS d2,
         CAST(o.o_orderdate + INTERVAL '40' DAY AS DATE) AS df,
         lpad(CAST(o.o_orderkey % 1000000 AS STRING), 6, '0') AS seq
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN supplier s ON s.s_suppkey = o.o_orderkey % (SELECT count(*) FROM supplier)
), named AS (
  SELECT *, CAST(year(df) AS STRING) || '-CA-' || seq || '-O' AS case_number,
    {_month_name('d1')} || ' ' || CAST(day(d1) AS STRING) AS md1,
    {_month_name('d2')} || ' ' || CAST(day(d2) AS STRING) AS md2,
    CAST(year(d1) AS STRING) AS y1, CAST(year(d2) AS STRING) AS y2,
    lpad(CAST(month(df) AS STRING), 2, '0') || '/' || lpad(CAST(day(df) AS STRING), 2, '0')
      || '/' || CAST(year(df) AS STRING) AS filed
  FROM base
), body AS (
  SELECT *, CASE variant
    WHEN 0 THEN 'FACTS IN SUPPORT OF CLAIMS' || chr(10) || 'On or about ' || md1 || ', ' || y1 || ', a collision took place.'
    WHEN 1 THEN 'GENERAL ALLEGATIONS' || chr(10) || 'The incident occurred on ' || md1 || ', ' || y1 || ' near the premises.'
    WHEN 2 THEN 'The parties dispute the account.'
    WHEN 3 THEN 'Date of accident: ' || CAST(month(d1) AS STRING) || '/' || CAST(day(d1) AS STRING) || '/' || y1 || '.'
    WHEN 4 THEN 'FACTS' || chr(10) || 'On ' || md1 || ', ' || y1 || ' the resident fell.' || chr(10)
      || 'The care record shows a long stay in the ward after that. Then death came at ' || md2 || ', ' || y2 || ' in the hospital.'
    WHEN 5 THEN 'On or about ' || md1 || ',' || y1 || ' the goods were lost.'
    WHEN 6 THEN 'No time is stated.'
    ELSE 'The subject incident happened at approximately 10:30 a.m. on ' || md1 || 'th, ' || y1 || '.' END AS facts
  FROM named
), filings AS (
  SELECT filing_id, variant, county, case_number, d1 AS true_date, df AS filed_on,
    county || '/' || case_number || '/' || CAST(df AS STRING) || '/Complaint' || CAST(variant AS STRING) || '.pdf' AS doc_path,
    'Case Number: ' || chr(10) || case_number || chr(10)
    || CASE WHEN variant IN (2, 4) THEN 'Filed: ' || filed || chr(10) ELSE '' END
    || plaintiff_name || ', Plaintiff, vs. ' || defendant_name || ', Defendant.' || chr(10)
    || facts || chr(10) || 'WHEREFORE relief is sought.' || chr(10)
    || CASE WHEN variant % 3 = 0 THEN 'PLAINTIFF HEREBY DEMANDS A JURY TRIAL ON ALL ISSUES SO TRIABLE.'
            WHEN variant % 3 = 1 THEN 'Plaintiff demands trial by jury on all issues triable as of right.'
            ELSE 'End of pleading.' END || chr(10)
    || 'Respectfully submitted' || chr(10) || 'Law Office of ' || plaintiff_name || chr(10)
    || 'office' || seq || '@example.com' || chr(10) || 'Attorneys for Plaintiff' || chr(10) || 'Bar 1' AS text
  FROM body
)"""

# Documents the date comparison cannot handle: a month name alone beats a real date.
TROUBLED_CTE = """troubled AS (
  SELECT filing_id, variant, county, doc_path,
    CASE WHEN variant = 6 AND filing_id % 3 = 0 THEN CAST(NULL AS STRING)
         WHEN variant = 5 THEN 'Paid on the ledger ' || CAST(month(true_date) AS STRING) || '/'
           || CAST(day(true_date) AS STRING) || '/' || CAST(year(true_date) AS STRING)
           || ' in full. Nothing else of note was written down by the clerk here.'
           || ' On or about September 3,2025 it began.'
         ELSE text END AS text
  FROM filings
)"""

CASE_DOCUMENTS_CTE = """case_documents AS (
  SELECT concat('case', CAST(filing_id - filing_id % 4 AS STRING)) AS case_id,
    CASE WHEN (filing_id % 8) < 4 THEN 'Orange County' ELSE 'Lake County' END AS court_name,
    filing_id % 4 AS idx,
    CASE WHEN filing_id % 11 = 0 THEN NULL ELSE doc_path END AS doc_path,
    CASE WHEN filing_id % 2 = 0 THEN 'Initial Complaint' ELSE 'Motion' END AS description,
    CASE WHEN filing_id % 5 = 0 THEN 'old date' END AS incident_date
  FROM filings
)"""

BATCH_REQUESTS_CTE = """batch_requests AS (
  SELECT o_orderkey AS request_id,
    CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN '  Orange County '
         ELSE o_orderpriority END AS county_name,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' ' || o_orderpriority || ' ' END AS document_type,
    CAST(o_orderdate AS DATE) AS date_to,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL
         ELSE CAST(o_orderdate + INTERVAL '20' DAY AS DATE) END AS late_from,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL
         WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate + INTERVAL '20' DAY AS DATE)
         ELSE CAST(o_orderdate - INTERVAL '20' DAY AS DATE) END AS date_from
  FROM orders
)"""

DOCUMENT_REQUESTS_CTE = """document_requests AS (
  SELECT o_orderkey AS case_id,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL
         WHEN o_orderkey % 4 = 1 THEN lpad(CAST(o_orderkey AS STRING), 24, 'a')
         WHEN o_orderkey % 4 = 2 THEN lpad(CAST(o_orderkey AS STRING), 24, 'z')
         ELSE CAST(o_orderkey AS STRING) END AS mongo_id,
    CASE WHEN o_orderkey % 6 = 0 THEN '   ' ELSE '  orangecounty/' || o_orderpriority || '/x.pdf ' END AS doc_path,
    CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS document_description
  FROM orders
)"""


SPREAD_KEYS = {"orders": "o_orderkey", "documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  One file gives one task, and the filing text made from an
    order costs far more than reading it: rows are dealt out by key, at every size alike."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, SPREAD_KEYS[name]) if name in SPREAD_KEYS else df


def run_sql(spark: SparkSession, sf_dir: str, ctes: list[str], select: str, **frames) -> DataFrame:
    """Run fixture CTEs on Spark; table names become frame arguments."""
    import re

    sql = f"WITH {', '.join(ctes)} {select}"
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    tables = {t: frames.get(t) or table(spark, sf_dir, t) for t in used}
    return spark.sql(sql, **tables)


def filings(spark: SparkSession, sf_dir: str, **frames) -> DataFrame:
    return run_sql(spark, sf_dir, [FILINGS_CTE], "SELECT * FROM filings", **frames)


def troubled_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, [FILINGS_CTE, TROUBLED_CTE], "SELECT * FROM troubled")


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(
        spark, sf_dir, [FILINGS_CTE, CASE_DOCUMENTS_CTE], "SELECT * FROM case_documents"
    )


def with_elements(filings: DataFrame) -> DataFrame:
    """Layout elements of each filing as an array, made from its own lines.

    A value after a label line (ending in ``:``) stands right of the label.
    """
    def number(lines):
        return F.transform(
            lines,
            lambda x, i: F.struct(
                x.alias("text"), i.alias("line_no"),
                F.endswith(F.coalesce(F.get(lines, i - 1), F.lit("")), F.lit(":")).alias("labelled"),
            ),
        )

    numbered = let(F.transform(F.split("text", "\n", -1), strip), number)
    filled = F.filter(numbered, lambda e: F.length(e["text"]) > 0)

    def element(e, i):
        x0 = F.when(e["labelled"], F.lit(200.0)).otherwise(F.lit(72.0))
        row = F.when(e["labelled"], e["line_no"] - 1).otherwise(e["line_no"])
        return F.struct(
            F.lit(0).alias("page"), i.alias("elem_idx"), e["text"].alias("text"),
            x0.alias("x0"), (x0 + 6.0 * F.length(e["text"])).alias("x1"),
            (F.lit(760.0) - 12.0 * row).alias("y0"),
        )

    return filings.withColumn("elements", F.transform(filled, element))


def layout_elements(filings: DataFrame) -> DataFrame:
    """The same elements, one row each."""
    return with_elements(filings).select("filing_id", F.inline("elements"))
