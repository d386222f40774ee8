"""Every operator as a query over the driver tables, with its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .. import fixtures as X
from ..functions import dates as D
from ..functions import regex as R
from ..functions import text as N
from ..operators import catalog as C
from ..operators import contact as K
from ..operators import layout as L
from ..operators import report as P
from ..operators import rules as FR
from ..operators import validate as Q
from ..plans.extract import extract, field_column, with_fields
from ..plans.runs import batch_job, batch_run, individual_job, individual_run
from ..session import shared_folder
from ..sources import packs as PK
from ..sources import sinks as SK
from ..sources import tables as TB
from ..streaming import jobs as ST
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

COUNTIES = [f"nation_{i}county" for i in range(20)]  # 20 to 24 have no pack
ALL_COUNTIES = [f"nation_{i}county" for i in range(25)]
PACK = O.PACK
SUMMED = ("incident_date", "error")
#: What a report reads of the results.
REPORTED = (
    "incident_date", "incident_source_field", "incident_end_date", "all_incident_dates", "emails", "error", "multiple_dates",
)
RESULT_FIELDS = (
    "filing_id", "county", "incident_date", "incident_source_field", "incident_end_date",
    "incident_end_source_field", "emails", "plaintiff_contact", "error",
)


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def on_filings(select: str, *ctes: str) -> str:
    return O.sql([X.FILINGS_CTE, *ctes], select)


def on_troubled(select: str, *ctes: str) -> str:
    return O.sql([X.FILINGS_CTE, X.TROUBLED_CTE, *ctes], select)


def documents(spark, sf):
    return X.table(spark, sf, "documents")


def results_of(filings: DataFrame, counties=COUNTIES, **options) -> DataFrame:
    named = X.with_elements(filings).withColumn("pdf_file", C.local_name(F.col("doc_path")))
    return extract(named, [PACK.for_counties(counties)], **options)


def nested_cases(flat: DataFrame) -> DataFrame:
    """The catalog in its nested shape: four documents per case."""
    text = T.StringType()
    doc = F.struct(
        "idx", "doc_path", "description", "incident_date",
        *[F.lit(None).cast(text).alias(c) for c in (
            "incident_end_date", "emails", "plaintiff_contact", "extraction_timestamp", "extracted_by")],
    )
    gathered = F.array_sort(F.collect_list(doc))
    return flat.groupBy("case_id", "court_name").agg(
        F.transform(gathered, lambda d: d.dropFields("idx")).alias("documents")
    )


def cases_of(spark, sf) -> DataFrame:
    return nested_cases(X.case_documents(spark, sf))


def flat_cases(cases: DataFrame, *more: str) -> DataFrame:
    return cases.select(
        "case_id", "court_name", *more, F.posexplode("documents").alias("idx", "d")
    ).select(
        "case_id", "court_name", *more, F.col("idx").cast("long").alias("idx"), "d.doc_path",
        "d.description", "d.incident_date", "d.incident_end_date", "d.emails",
        "d.plaintiff_contact", "d.extraction_timestamp", "d.extracted_by",
    )


# ---------------------------------------------------------------- sources and sinks


@query(
    "s1_catalog_scan",
    on_filings(
        "SELECT case_id, court_name, idx, doc_path, description, incident_date FROM case_documents"
        " WHERE court_name = 'Orange County'", X.CASE_DOCUMENTS_CTE),
)
def s1(spark, sf):
    cases = cases_of(spark, sf).where(F.col("court_name") == "Orange County")
    return flat_cases(cases).select(
        "case_id", "court_name", "idx", "doc_path", "description", "incident_date")


NAMED = "SELECT filing_id, CASE WHEN variant = 3 THEN upper({x}) ELSE {x} END AS name FROM filings"


@query(
    "s2_filing_listing",
    on_filings("SELECT filing_id, name FROM (" + NAMED.format(x="split_part(doc_path, '/', 4)")
               + ") WHERE suffix(name, '.pdf')"),
)
def s2(spark, sf):
    base = TB.base_name(F.col("doc_path"))
    name = F.when(F.col("variant") == 3, F.upper(base)).otherwise(base)
    named = X.filings(spark, sf).select("filing_id", name.alias("name"))
    return named.where(TB.is_pdf(F.col("name")))


@query(
    "s3_layout_elements",
    on_filings("SELECT filing_id, page, elem_idx, text, x0, x1, y0 FROM layout_elements",
               *O.elements_ctes("filings")),
)
def s3(spark, sf):
    rows = L.clean_elements(X.layout_elements(X.filings(spark, sf)))
    return rows.select("filing_id", "page", "elem_idx", "text", "x0", "x1", "y0")


@query(
    "s4_page_concat",
    "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0),"
    " chr(10)) || chr(10) AS text FROM documents WHERE length(replace(text, chr(10), '')) > 0",
)
def s4(spark, sf):
    pages = documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "page_text"))
    return L.concat_pages(pages, "doc_id")


@query(
    "s5_pack_fields",
    on_filings(
        " UNION ALL ".join(
            f"SELECT {i} AS pos, '{f}' AS field, '{kind}' AS rule_type, count({f}) AS n_filled FROM fields"
            for i, (f, kind) in enumerate(O.PACK_FIELDS)),
        *O.fields_ctes("filings")),
)
def s5(spark, sf):
    step = with_fields(X.with_elements(X.filings(spark, sf)), PACK)
    counts = step.agg(*[F.count(field_column(f)).alias(f) for f in PACK.fields])
    rows = [
        F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"),
                 F.lit(PACK.rules[f]["type"]).alias("rule_type"), F.col(f).alias("n_filled"))
        for i, f in enumerate(PACK.fields)
    ]
    return counts.select(F.inline(F.array(*rows)))


@query(
    "s6_pack_by_county",
    on_filings(
        "SELECT county, has_pack, count(*) AS filings, count(incident_date) AS with_date,"
        " count(emails) AS with_emails FROM results GROUP BY ALL",
        *O.results_ctes("filings", COUNTIES)),
)
def s6(spark, sf):
    results = results_of(X.filings(spark, sf))
    return results.groupBy("county", F.col("county").isin(COUNTIES).alias("has_pack")).agg(
        F.count(F.lit(1)).alias("filings"), F.count("incident_date").alias("with_date"),
        F.count("emails").alias("with_emails"))


@query(
    "s7_individual_pack",
    on_filings("SELECT filing_id, 'individual' AS county, incident_date, plaintiff_contact FROM results",
               *O.results_ctes("filings")),
)
def s7(spark, sf):
    filings = X.with_elements(X.filings(spark, sf))
    results = individual_run(filings, PK.individual_pack())
    return results.select("filing_id", "county", "incident_date", "plaintiff_contact")


@query(
    "s8_mapping_source",
    on_filings("SELECT split_part(doc_path, '/', 4) AS file_name, CAST(filing_id AS VARCHAR) AS doc_id,"
               " doc_path AS original_path FROM filings WHERE filing_id % 13 <> 0"),
)
def s8(spark, sf):
    path = F.col("doc_path")
    entry = F.to_json(F.create_map(TB.base_name(path), F.struct(
        F.col("filing_id").cast("string").alias("doc_id"), path.alias("original_path"))))
    broken = F.lit('{"a.pdf": {"doc_id": ')
    text = F.when(F.col("filing_id") % 13 == 0, broken).otherwise(entry)
    rows = TB.decode_mapping(X.filings(spark, sf).select(text.alias("value")), "value")
    return rows.select("file_name", "doc_id", "original_path")


@query(
    "s9_document_json",
    on_filings("SELECT filing_id, county, replace(split_part(doc_path, '/', 2), '-', '_') || '_Complaint'"
               " || CAST(variant AS VARCHAR) AS stem, incident_date FROM results",
               *O.results_ctes("filings", COUNTIES)),
)
def s9(spark, sf):
    path = shared_folder(spark, "document-json")
    results_of(X.filings(spark, sf)).write.parquet(f"{path}-results")
    SK.write_per_document_json(spark.read.parquet(f"{path}-results"), path, rows_per_file=500)
    schema = "filing_id long, stem string, incident_date string, county string"
    return spark.read.schema(schema).json(path).select("filing_id", "county", "stem", "incident_date")


@query(
    "s10_batch_json",
    on_filings("SELECT 'run1' AS run_id, filing_id, incident_date, n_dates FROM results",
               *O.results_ctes("filings", COUNTIES)),
)
def s10(spark, sf):
    path = shared_folder(spark, "batch-json")
    SK.write_batch_json(results_of(X.filings(spark, sf)), path, "run1")
    schema = ("filing_id long, incident_date string, run_id string,"
              "all_incident_dates array<struct<standard_date:string>>")
    return spark.read.schema(schema).json(path).select(
        "run_id", "filing_id", "incident_date",
        F.size("all_incident_dates").cast("long").alias("n_dates"))


def _report_sql(source: str) -> str:
    """Report rows from CTE ``results`` (joined with the multi-date field)."""
    plain = f"coalesce({O.padded('incident_date')}, false)"
    seen = f"(any_true AND NOT {plain})"
    multi = f"CASE WHEN {seen} THEN coalesce(multi, '') ELSE 'NA' END"
    parts = f"list_transform(string_split(multi, ' | '), lambda p: {O.parse_date(O.bare('p'))})"
    standard = f"array_to_string(list_filter({parts}, lambda d: d IS NOT NULL), ' | ')"
    cols = {
        "incident_date": f"CASE WHEN {seen} THEN incident_date ELSE 'NA' END",
        "incident_end_date": f"CASE WHEN {seen} THEN coalesce(incident_end_date, '') ELSE '' END",
        "standard_incident_date": f"CASE WHEN {seen} THEN coalesce({O.parse_date('incident_date')}, '') ELSE 'NA' END",
        "standard_incident_end_date": f"CASE WHEN {seen} THEN coalesce({O.parse_date('incident_end_date')}, '') ELSE '' END",
        "is_incident": f"CASE WHEN {seen} AND {O.is_true('incident_source_field', 'incident_date')} THEN 'True' ELSE 'False' END",
        "all_dates_count": "CAST(n_dates AS VARCHAR)",
        "multiple_dates": f"CASE WHEN length({multi}) > 100 THEN substr({multi}, 1, 100) || '...' ELSE {multi} END",
        "standard_multiple_dates": f"CASE WHEN {seen} AND multi IS NOT NULL THEN {standard} ELSE '' END",
        "emails": "coalesce(emails, '')",
    }
    shown = ", ".join(f"CASE WHEN error IS NOT NULL THEN '' ELSE {c} END AS {n}" for n, c in cols.items())
    return (
        "SELECT replace(split_part(doc_path, '/', 2), '-', '_') || '_' || split_part(doc_path, '/', 4) AS pdf_file,"
        " county, CASE WHEN error IS NOT NULL THEN '' ELSE 'id' || CAST(filing_id AS VARCHAR) END AS mongo_doc_id,"
        f" {shown}, CASE WHEN error IS NULL THEN 'Success' ELSE 'ERROR: ' || error END AS status"
        f" FROM results LEFT JOIN (SELECT filing_id, {V.MULTI_DATE_FIELD} AS multi FROM fields) USING (filing_id)"
    )


def reported(spark, sf):
    results = results_of(X.troubled_filings(spark, sf), ALL_COUNTIES, outputs=REPORTED)
    return results.withColumn("mongo_doc_id", F.concat(F.lit("id"), F.col("filing_id").cast("string")))


REPORT_SQL = on_troubled(_report_sql("troubled"), *O.results_ctes("troubled"))


@query(
    "s11_report_csv",
    on_troubled(
        f"SELECT nullif(pdf_file, '') AS file, nullif(incident_date, '') AS incident_date,"
        f" nullif(standard_multiple_dates, '') AS dates, status FROM ({_report_sql('troubled')})",
        *O.results_ctes("troubled")),
)
def s11(spark, sf):
    path = shared_folder(spark, "report-csv")
    SK.write_report_csv(reported(spark, sf), path)
    schema = ", ".join(f"`{c}` string" for c in V.REPORT_COLUMNS)
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.select(
        F.col("PDF File").alias("file"), F.col("Incident Date").alias("incident_date"),
        F.col("Standard Multiple Dates").alias("dates"), F.col("Status").alias("status"))


# ---------------------------------------------------------------- catalog


@query(
    "r1_catalog_filter",
    on_filings(
        "SELECT case_id, any_value(court_name) AS court_name, count(*) AS n_documents FROM case_documents"
        " GROUP BY case_id HAVING regexp_matches(any_value(court_name), '(?i)orange')"
        " AND bool_or(regexp_matches(description, '(?i)complaint'))", X.CASE_DOCUMENTS_CTE),
)
def r1(spark, sf):
    found = C.find_cases(cases_of(spark, sf), "orange", "complaint")
    return found.select("case_id", "court_name", F.size("documents").cast("long").alias("n_documents"))


@query(
    "r2_document_explode",
    on_filings(
        "SELECT case_id, idx, doc_path FROM case_documents WHERE doc_path IS NOT NULL AND doc_path <> ''"
        " AND case_id IN (SELECT case_id FROM case_documents WHERE court_name = 'Orange County'"
        " AND regexp_matches(description, '(?i)complaint'))", X.CASE_DOCUMENTS_CTE),
)
def r2(spark, sf):
    found = C.find_cases(cases_of(spark, sf), "orange", "complaint")
    return C.document_paths(found).withColumn("idx", F.col("idx").cast("long"))


@query(
    "r3_date_window",
    O.sql([X.BATCH_REQUESTS_CTE],
          "SELECT request_id, date_to, coalesce(late_from, CAST(date_to - INTERVAL '365' DAY AS DATE)) AS date_from,"
          " CAST(date_to - INTERVAL '100' DAY AS DATE) BETWEEN coalesce(late_from, CAST(date_to - INTERVAL '365' DAY AS DATE))"
          " AND date_to AS in_window FROM batch_requests"),
)
def r3(spark, sf):
    requests = X.run_sql(spark, sf, [X.BATCH_REQUESTS_CTE], "SELECT * FROM batch_requests")
    start, end = F.col("late_from"), F.col("date_to")
    return requests.select(
        "request_id", "date_to", C.default_date_from(start, end).alias("date_from"),
        C.in_date_window(start, end, F.date_sub(end, 100)).alias("in_window"))


SHORT_PATH = "CASE WHEN filing_id % 17 = 0 THEN county || '/' || case_number ELSE doc_path END"


@query(
    "r4_local_name",
    on_filings(
        f"SELECT filing_id, CASE WHEN len(p) >= 4 THEN replace(p[2], '-', '_') || '_' || p[4] END AS file_name"
        f" FROM (SELECT filing_id, string_split({SHORT_PATH}, '/') AS p FROM filings)"),
)
def r4(spark, sf):
    rows = X.filings(spark, sf).withColumn("doc_path", F.expr(SHORT_PATH))
    return rows.select("filing_id", C.local_name(F.col("doc_path")).alias("file_name"))


# paths without the running number, so very many documents share a local name
SHARED = ("SELECT filing_id, CAST(filing_id AS {text}) AS doc_id,"
          " replace(doc_path, case_number, substr(case_number, 1, 7)) AS doc_path FROM filings")


@query(
    "r5_mapping_build",
    on_filings(
        "SELECT file_name, arg_max(doc_id, filing_id) AS doc_id, arg_max(doc_path, filing_id) AS original_path FROM ("
        "SELECT *, replace(split_part(doc_path, '/', 2), '-', '_') || '_' || split_part(doc_path, '/', 4) AS file_name"
        f" FROM ({SHARED.format(text='VARCHAR')})) GROUP BY file_name"),
)
def r5(spark, sf):
    shared = X.run_sql(spark, sf, [X.FILINGS_CTE], SHARED.format(text="STRING"))
    return C.build_mapping(shared, ["filing_id"]).select("file_name", "doc_id", "original_path")


FILE = "replace(split_part(doc_path, '/', 2), '-', '_') || '_' || split_part(doc_path, '/', 4)"
# a third of the keys lack the year, a few are short enough to fit many files
KEYED = f"""keyed AS (SELECT filing_id AS seq, 'd' || CAST(filing_id AS {{text}}) AS doc_id, doc_path AS original_path,
  CASE WHEN filing_id % 3 = 0 THEN substr({FILE}, 6) ELSE {FILE} END AS file_name
  FROM filings WHERE filing_id % 5 <> 0
  UNION ALL SELECT 1000000 + min(filing_id), 'shared' || CAST(min(filing_id) AS {{text}}), min(doc_path),
    'Complaint' || CAST(variant AS {{text}}) || '.pdf' FROM filings WHERE variant < 4 GROUP BY variant)"""


def _map(spark, sf):
    files = X.run_sql(spark, sf, [X.FILINGS_CTE], f"SELECT filing_id, {FILE} AS pdf_file FROM filings")
    keys = X.run_sql(spark, sf, [X.FILINGS_CTE, KEYED.format(text="STRING")], "SELECT * FROM keyed")
    return files, keys


@query(
    "r6_mapping_exact",
    on_filings(
        f"SELECT filing_id, f.pdf_file, k.doc_id AS mongo_doc_id, k.original_path AS original_gcs_path FROM"
        f" (SELECT filing_id, {FILE} AS pdf_file FROM filings) f LEFT JOIN keyed k ON f.pdf_file = k.file_name"
        " AND seq < 1000000 AND seq % 3 <> 0",
        KEYED.format(text="VARCHAR")),
)
def r6(spark, sf):
    files, keys = _map(spark, sf)
    whole_names = keys.where("seq < 1000000 AND seq % 3 <> 0")
    return C.map_files(files, whole_names, "seq").select(
        "filing_id", "pdf_file", "mongo_doc_id", "original_gcs_path")


@query(
    "r7_mapping_suffix",
    on_filings(
        f"""SELECT filing_id, pdf_file, arg_min(doc_id, pick) AS mongo_doc_id, arg_min(original_path, pick) AS original_gcs_path FROM (
  SELECT f.filing_id, f.pdf_file, k.doc_id, k.original_path,
    CASE WHEN k.file_name = f.pdf_file THEN -1 ELSE k.seq END AS pick FROM
    (SELECT filing_id, pdf_file, unnest(list_transform(range(1, length(pdf_file) + 1), lambda n: right(pdf_file, n))) AS suffix
     FROM (SELECT filing_id, {FILE} AS pdf_file FROM filings)) f
    LEFT JOIN keyed k ON k.file_name = f.suffix) GROUP BY filing_id, pdf_file""",
        KEYED.format(text="VARCHAR")),
)
def r7(spark, sf):
    files, keys = _map(spark, sf)
    return C.map_files(files, keys, "seq").select(
        "filing_id", "pdf_file", "mongo_doc_id", "original_gcs_path")


# new values for two thirds of the documents, written twice, some for unknown paths
UPDATES = """updates AS (SELECT case_id, doc_path, n AS extraction_timestamp,
    CASE WHEN idx = 1 THEN NULL WHEN incident_date IS NOT NULL AND idx = 2 THEN incident_date
      ELSE 'date ' || CAST(n AS {text}) END AS incident_date,
    CAST(NULL AS {text}) AS incident_end_date,
    CASE WHEN idx = 1 THEN '' WHEN idx = 2 THEN NULL ELSE 'a@b.org' END AS emails, CAST(NULL AS {text}) AS plaintiff_contact
  FROM (SELECT case_id, idx, incident_date, CASE WHEN idx = 3 AND description = 'Motion' AND incident_date IS NULL
      THEN 'unknown/' || case_id ELSE doc_path END AS doc_path FROM case_documents WHERE idx > 0) c
    CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) t WHERE doc_path IS NOT NULL),
  latest AS (SELECT * FROM updates WHERE extraction_timestamp = 2)"""


def _updates(spark, sf):
    return X.run_sql(
        spark, sf, [X.FILINGS_CTE, X.CASE_DOCUMENTS_CTE, UPDATES.format(text="STRING")],
        "SELECT * FROM updates")


UPDATE_CTES = (X.CASE_DOCUMENTS_CTE, UPDATES.format(text="VARCHAR"))


@query(
    "r8_update_batch",
    on_filings(
        "SELECT c.case_id, c.idx, c.doc_path, CASE WHEN u.case_id IS NULL THEN c.incident_date ELSE u.incident_date END AS incident_date,"
        " u.emails FROM case_documents c LEFT JOIN latest u ON c.case_id = u.case_id AND c.doc_path = u.doc_path",
        *UPDATE_CTES),
)
def r8(spark, sf):
    cases, _ = C.update_batch(cases_of(spark, sf), _updates(spark, sf), "extraction_timestamp")
    return flat_cases(cases).select("case_id", "idx", "doc_path", "incident_date", "emails")


@query(
    "r8_update_status",
    on_filings(
        "SELECT u.case_id, u.doc_path, CASE WHEN c.case_id IS NULL THEN 'not_found' WHEN c.incident_date IS NOT DISTINCT FROM"
        " u.incident_date AND u.emails IS NULL THEN 'unchanged' ELSE 'updated' END AS status"
        " FROM latest u LEFT JOIN case_documents c ON c.case_id = u.case_id AND c.doc_path = u.doc_path",
        *UPDATE_CTES),
)
def r8_status(spark, sf):
    return C.update_batch(cases_of(spark, sf), _updates(spark, sf), "extraction_timestamp")[1]


INDIVIDUAL_SQL = on_filings(
    "SELECT c.case_id, c.idx, coalesce(nullif(u.incident_date, ''), c.incident_date) AS incident_date,"
    " nullif(u.emails, '') AS emails, CAST(u.extraction_timestamp AS VARCHAR) AS extraction_timestamp,"
    " CASE WHEN u.case_id IS NOT NULL THEN 'individual_pdf_service' END AS extracted_by,"
    " max(u.extraction_timestamp) OVER (PARTITION BY c.case_id) IS NOT NULL AS touched"
    " FROM case_documents c LEFT JOIN (SELECT * FROM latest WHERE coalesce(nullif(incident_date, ''),"
    " nullif(emails, '')) IS NOT NULL) u ON c.case_id = u.case_id AND c.doc_path = u.doc_path",
    *UPDATE_CTES)


def _individual_columns(cases: DataFrame) -> DataFrame:
    flat = flat_cases(cases, "updated_at")
    return flat.select(
        "case_id", "idx", "incident_date", "emails", "extraction_timestamp", "extracted_by",
        F.col("updated_at").isNotNull().alias("touched"))


@query("r9_update_individual", INDIVIDUAL_SQL)
def r9(spark, sf):
    return _individual_columns(C.update_individual(cases_of(spark, sf), _updates(spark, sf)))


@query(
    "r10_update_guard",
    on_filings("SELECT case_id, doc_path, incident_date, emails FROM latest"
               " WHERE coalesce(nullif(incident_date, ''), nullif(emails, '')) IS NOT NULL", *UPDATE_CTES),
)
def r10(spark, sf):
    rows = _updates(spark, sf).where("extraction_timestamp = 2")
    return C.has_values(rows).select("case_id", "doc_path", "incident_date", "emails")


@query(
    "r11_catalog_id",
    O.sql([X.DOCUMENT_REQUESTS_CTE],
          "SELECT case_id, mongo_id, coalesce(length(mongo_id) = 24, false) AS usable FROM document_requests"),
)
def r11(spark, sf):
    rows = X.run_sql(spark, sf, [X.DOCUMENT_REQUESTS_CTE], "SELECT * FROM document_requests")
    return rows.select("case_id", "mongo_id", C.valid_catalog_id(F.col("mongo_id")).alias("usable"))


@query(
    "r12_documents_json",
    on_filings(
        "SELECT filing_id, CASE WHEN filing_id % 5 = 0 THEN 'no documents' WHEN filing_id % 5 = 1 THEN 'invalid JSON' END AS problem,"
        " CASE WHEN filing_id % 5 > 1 THEN doc_path END AS doc_path FROM filings"),
)
def r12(spark, sf):
    good = F.to_json(F.array(F.struct("doc_path")))
    text = (F.when(F.col("filing_id") % 5 == 0, F.lit(None).cast("string"))
            .when(F.col("filing_id") % 5 == 1, F.concat(F.lit('[{"doc_path": '), F.col("doc_path")))
            .otherwise(good))
    rows = X.filings(spark, sf).select("filing_id", text.alias("documents"))
    body = F.col("documents")
    return rows.select(
        "filing_id", C.documents_problem(body).alias("problem"),
        F.get(C.parse_documents(body), F.lit(0))["doc_path"].alias("doc_path"))


def json_cases(spark, sf) -> DataFrame:
    """The catalog as a JSON store: some cases without text, some with broken text, a key the library does not know."""
    cases = cases_of(spark, sf)
    number = F.substring("case_id", 5, 20).cast("long") / 4
    text = F.to_json(F.transform("documents", lambda d: F.struct(
        d["doc_path"].alias("doc_path"), d["description"].alias("description"),
        d["incident_date"].alias("incident_date"), F.lit("k").alias("note"))))
    broken = F.when(number % 7 == 0, F.lit('[{"doc_path": ')).when(number % 7 == 1, F.lit(""))
    return cases.withColumn("documents", F.coalesce(broken, text))


@query(
    "r12_json_store",
    on_filings(
        "SELECT c.case_id, c.idx, c.doc_path, coalesce(nullif(u.incident_date, ''), c.incident_date) AS incident_date,"
        " nullif(u.emails, '') AS emails, CASE WHEN u.case_id IS NOT NULL THEN 'individual_pdf_service' END AS extracted_by,"
        " 'k' AS note, CAST(NULL AS VARCHAR) AS reason FROM numbered c LEFT JOIN (SELECT * FROM latest WHERE"
        " coalesce(nullif(incident_date, ''), nullif(emails, '')) IS NOT NULL) u ON c.case_id = u.case_id AND c.doc_path = u.doc_path"
        " WHERE k > 1 UNION ALL SELECT DISTINCT case_id, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),"
        " CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),"
        " CASE k WHEN 0 THEN 'invalid JSON' ELSE 'no documents' END FROM numbered WHERE k < 2",
        *UPDATE_CTES,
        "numbered AS (SELECT *, CAST(substr(case_id, 5) AS BIGINT) // 4 % 7 AS k FROM case_documents)"),
)
def r12_store(spark, sf):
    cases, _, rejected = C.update_json_store(json_cases(spark, sf), _updates(spark, sf))
    shape = "array<struct<doc_path:string,incident_date:string,emails:string,extracted_by:string,note:string>>"
    flat = cases.select("case_id", F.posexplode(F.from_json("documents", shape)).alias("idx", "d")).select(
        "case_id", F.col("idx").cast("long").alias("idx"), "d.*", F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(t).alias(c) for c, t in flat.dtypes if c not in ("case_id", "reason")]
    return flat.unionByName(rejected.select("case_id", *none, "reason"))


@query(
    "r13_updated_stores",
    on_filings(
        "SELECT filing_id, CASE filing_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'MongoDB' WHEN 2 THEN 'PostgreSQL'"
        " ELSE 'MongoDB & PostgreSQL' END AS stores FROM filings"),
)
def r13(spark, sf):
    key = F.col("filing_id")
    return X.filings(spark, sf).select(
        "filing_id", C.updated_stores(key % 2 == 1, key % 4 >= 2).alias("stores"))


@query(
    "r14_error_rows",
    on_troubled("SELECT filing_id, county, error, incident_date, emails FROM results WHERE error IS NOT NULL",
                *O.results_ctes("troubled")),
)
def r14(spark, sf):
    results = results_of(X.troubled_filings(spark, sf), ALL_COUNTIES)
    return results.where(F.col("error").isNotNull()).select(
        "filing_id", "county", "error", "incident_date", "emails")


# ---------------------------------------------------------------- request checks

CHECKED_BATCH = O.sql(
    [X.BATCH_REQUESTS_CTE],
    "SELECT request_id, replace(trim(lower(county_name)), ' ', '_') AS county_name,"
    " trim(lower(document_type)) AS document_type, CASE WHEN county_name = '' THEN 'county_name is empty'"
    " WHEN document_type = '' THEN 'document_type is empty' WHEN date_from > date_to"
    " THEN 'date_from must be before date_to' END AS reject_reason FROM batch_requests")


@query("v1_v2_v3_batch_requests", CHECKED_BATCH)
def v1(spark, sf):
    rows = X.run_sql(spark, sf, [X.BATCH_REQUESTS_CTE], "SELECT * FROM batch_requests")
    return Q.check_batch_requests(rows).select(
        "request_id", "county_name", "document_type", "reject_reason")


@query(
    "v4_v5_v6_document_requests",
    O.sql([X.DOCUMENT_REQUESTS_CTE],
          "SELECT CAST(case_id AS VARCHAR) AS case_id, mongo_id, trim(doc_path) AS doc_path, CASE"
          " WHEN mongo_id IS NOT NULL AND length(mongo_id) <> 24 THEN 'mongo_id must be a 24-character hex string'"
          " WHEN NOT regexp_full_match(mongo_id, '[0-9a-fA-F]+') THEN 'mongo_id must be a valid ObjectId hex string'"
          " WHEN trim(doc_path) = '' THEN 'doc_path cannot be empty'"
          " WHEN document_description = '' THEN 'document_description is empty' END AS reject_reason FROM document_requests"),
)
def v4(spark, sf):
    rows = X.run_sql(spark, sf, [X.DOCUMENT_REQUESTS_CTE], "SELECT * FROM document_requests")
    return Q.check_document_requests(rows).select("case_id", "mongo_id", "doc_path", "reject_reason")


# ---------------------------------------------------------------- text

SPLIT_WORDS = f"regexp_replace(lower(text), '[\\s]+', ' ', 'g')"


@query(
    "n1_normalize_text",
    f"SELECT doc_id, translate(trim({SPLIT_WORDS}), {O.q(V.PUNCTUATION)}, '') AS normalized FROM documents",
)
def n1(spark, sf):
    return documents(spark, sf).select("doc_id", N.normalize_text(F.col("text")).alias("normalized"))


@query(
    "n2_lines",
    "SELECT doc_id, i - 1 AS line_no, CAST(coalesce(list_sum(list_transform(l[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT)"
    " AS start, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM"
    " (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
)
def n2(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.inline(N.lines_with_offsets(F.col("text"))))
    return rows.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"),
        F.col("offset").cast("long").alias("start"), "line")


@query(
    "n3_window",
    f"SELECT doc_id, {O.window('text', 'p - 50', 'p + 40')} AS near FROM"
    " (SELECT doc_id, text, strpos(lower(text), 'the') - 1 AS p FROM documents) WHERE p >= 0",
)
def n3(spark, sf):
    rows = documents(spark, sf).withColumn("p", N.position(F.lower("text"), "the")).where("p >= 0")
    p = F.col("p")
    return rows.select("doc_id", N.window(F.col("text"), p - 50, p + 40).alias("near"))


ANY_DATE = "|".join("(?:%s)" % p for p in PACK.rules["multiple_dates_extractor"]["date_patterns"])


@query(
    "n4_match_positions",
    O.sql([X.FILINGS_CTE, O.spans_cte("spans", "filings", O.rx(ANY_DATE), 0)],
          "SELECT filing_id, start, v AS matched FROM spans"),
)
def n4(spark, sf):
    spans = F.inline(R.match_spans(F.col("text"), ANY_DATE))
    return X.filings(spark, sf).select("filing_id", spans).select(
        "filing_id", F.col("start").cast("long").alias("start"), F.col("value").alias("matched"))


TWO_GROUPS = r"(on)\s+(January|February|March|April|May|June|July|August|September|October|November|December)?"


@query(
    "n5_best_group",
    on_filings(
        f"SELECT filing_id, CASE WHEN length(regexp_extract(text, {O.rx(TWO_GROUPS)}, 2)) > 2 THEN"
        f" regexp_extract(text, {O.rx(TWO_GROUPS)}, 2) ELSE nullif(regexp_extract(text, {O.rx(TWO_GROUPS)}, 1), '') END AS best FROM filings"),
)
def n5(spark, sf):
    return X.filings(spark, sf).select("filing_id", R.best_group(F.col("text"), TWO_GROUPS).alias("best"))


# ---------------------------------------------------------------- field rules


def _field_query(key: str, fields: list[str]) -> None:
    sql = on_filings(f"SELECT filing_id, {', '.join(fields)} FROM fields", *O.fields_ctes("filings"))

    @query(key, sql)
    def run(spark, sf):
        step = with_fields(X.with_elements(X.filings(spark, sf)), PACK, only=fields)
        return step.select("filing_id", *[field_column(f).alias(f) for f in fields])


def of_type(kind: str) -> list[str]:
    return [f for f in PACK.fields if PACK.rules[f]["type"] == kind]


_field_query("f1_regex", of_type("regex"))
_field_query("f2_nearest_word_array", of_type("nearest_word"))
_field_query("f3_section", of_type("section_pattern"))
_field_query("f4_facts_date", of_type("facts_pattern"))
_field_query("f5_case_title", of_type("case_title"))
_field_query("f6_fuzzy_date", of_type("fuzzy_date"))
_field_query("f7_contextual", of_type("contextual_search"))
_field_query("f8_multi_pattern", of_type("multi_pattern"))
_field_query("f9_multi_date", of_type("multi_date"))
_field_query("pack_all_fields", PACK.fields)

F2_FIELDS = of_type("nearest_word")


@query(
    "f2_nearest_word_join",
    on_filings(
        " UNION ALL ".join(
            f"SELECT filing_id, '{f}' AS field, value FROM e_{f} WHERE value IS NOT NULL" for f in F2_FIELDS),
        *O.elements_ctes("filings"), *[O.f2_cte(f"e_{f}", PACK.rules[f]) for f in F2_FIELDS]),
)
def f2_join(spark, sf):
    elements = X.layout_elements(X.filings(spark, sf))
    return L.nearest_word_join(elements, {f: PACK.rules[f] for f in F2_FIELDS}, "filing_id")


@query("f10_emails", on_filings(f"SELECT filing_id, {O.emails()} AS emails FROM filings"))
def f10(spark, sf):
    return X.filings(spark, sf).select("filing_id", FR.emails(F.col("text")).alias("emails"))


@query("f10_emails_documents", f"SELECT doc_id, {O.emails()} AS emails FROM documents")
def f10_documents(spark, sf):
    return documents(spark, sf).select("doc_id", FR.emails(F.col("text")).alias("emails"))


# ---------------------------------------------------------------- dates

DATE_TEXTS = """date_texts AS (SELECT o_orderkey AS id, CASE o_orderkey % 7
  WHEN 0 THEN 'On or about ' || CAST(month(o_orderdate) AS {t}) || '/' || CAST(day(o_orderdate) AS {t}) || '/' || CAST(year(o_orderdate) AS {t})
  WHEN 1 THEN 'May ' || CAST(day(o_orderdate) AS {t}) || 'th, ' || CAST(year(o_orderdate) AS {t})
  WHEN 2 THEN CAST(day(o_orderdate) AS {t}) || '-' || CAST(month(o_orderdate) AS {t}) || '-' || CAST(year(o_orderdate) AS {t})
  WHEN 3 THEN '13/45/' || CAST(year(o_orderdate) AS {t})
  WHEN 4 THEN 'collision on september 3 ' || CAST(year(o_orderdate) AS {t})
  WHEN 5 THEN '0' || CAST(o_orderkey % 9 + 1 AS {t}) || '/17/' || CAST(year(o_orderdate) AS {t}) ELSE o_orderpriority END AS value FROM orders)"""
FIELD_NAMES = PACK.fields


def date_texts(spark, sf):
    return X.run_sql(spark, sf, [DATE_TEXTS.format(t="STRING")], "SELECT * FROM date_texts")


def on_dates(select: str) -> str:
    return O.sql([DATE_TEXTS.format(t="VARCHAR")], select)


@query(
    "d1_parse_date",
    on_dates(f"SELECT id, value, std AS standard_date, CAST(try_strptime(std, '%Y-%m-%d') AS DATE) AS calendar_date FROM"
             f" (SELECT id, value, {O.parse_date('value')} AS std FROM date_texts)"),
)
def d1(spark, sf):
    rows = date_texts(spark, sf).withColumn("standard_date", D.parse_date(F.col("value")))
    return rows.withColumn("calendar_date", D.calendar_date(F.col("standard_date")))


@query(
    "d2_date_fields",
    on_filings(
        " UNION ALL ".join(
            f"SELECT '{f}' AS field, {str(f in O.DATE_FIELDS).lower()} AS is_date, count({f}) AS n FROM fields"
            for f in PACK.fields),
        *O.fields_ctes("filings")),
)
def d2(spark, sf):
    step = with_fields(X.with_elements(X.filings(spark, sf)), PACK)
    counts = step.agg(*[F.count(field_column(f)).alias(f) for f in PACK.fields])
    rows = [F.struct(F.lit(f).alias("field"), F.lit(D.is_date_field(f)).alias("is_date"),
                     F.col(f).alias("n")) for f in PACK.fields]
    return counts.select(F.inline(F.array(*rows)))


@query(
    "d3_month_number",
    O.sql([X.FILINGS_CTE],
          "SELECT filing_id, CASE WHEN filing_id % 9 = 0 THEN 1 ELSE month(true_date) END AS month_number FROM filings"),
)
def d3(spark, sf):
    name = F.when(F.col("filing_id") % 9 == 0, F.lit("Smarch")).otherwise(
        F.upper(F.date_format("true_date", "MMMM")))
    return X.filings(spark, sf).select(
        "filing_id", D.month_to_number(name).cast("long").alias("month_number"))


@query(
    "d4_standardize_multiple",
    on_filings(
        f"SELECT filing_id, array_to_string(list_filter(list_transform(string_split(multiple_dates_extractor, ' | '),"
        f" lambda p: {O.parse_date(O.bare('p'))}), lambda d: d IS NOT NULL), ' | ') AS dates FROM fields"
        " WHERE multiple_dates_extractor IS NOT NULL", *O.fields_ctes("filings")),
)
def d4(spark, sf):
    step = with_fields(X.filings(spark, sf), PACK, only=[V.MULTI_DATE_FIELD])
    value = field_column(V.MULTI_DATE_FIELD)
    return step.where(value.isNotNull()).select("filing_id", D.standardize_multiple(value).alias("dates"))


FIELD_OF = "[" + ", ".join(f"'{f}'" for f in FIELD_NAMES) + f"][CAST(id % {len(FIELD_NAMES)} AS INTEGER) + 1]"


@query(
    "d5_true_incident",
    on_dates(f"SELECT id, field, value, {O.is_true('field', 'value')} AS is_incident FROM"
             f" (SELECT id, {FIELD_OF} AS field, value FROM date_texts)"),
)
def d5(spark, sf):
    names = F.array(*[F.lit(f) for f in FIELD_NAMES])
    field = F.get(names, (F.col("id") % len(FIELD_NAMES)).cast("int"))
    rows = date_texts(spark, sf).withColumn("field", field)
    return rows.withColumn("is_incident", D.is_true_incident(F.col("field"), F.col("value")))


@query(
    "d6_candidates",
    on_filings("SELECT filing_id, field AS source_field, value AS original_date, std AS standard_date, tru AS is_incident"
               " FROM cand WHERE std IS NOT NULL", *O.results_ctes("filings", COUNTIES)),
)
def d6(spark, sf):
    results = results_of(X.filings(spark, sf))
    return results.select("filing_id", F.inline("all_incident_dates"))


@query(
    "d7_primary",
    on_filings("SELECT filing_id, value AS primary_date, field AS source_field FROM prim",
               *O.results_ctes("filings")),
)
def d7(spark, sf):
    from ..operators.resolve import candidate_array, primary_candidate

    step = with_fields(X.with_elements(X.filings(spark, sf)), PACK, only=filter(D.is_date_field, PACK.fields))
    primary = primary_candidate(candidate_array(PACK.fields, field_column))
    # bound, so that the filter does not pick the candidate a second time
    return N.bind(step, {"p": primary}).where(F.col("p").isNotNull()).select(
        "filing_id", F.col("p.value").alias("primary_date"), F.col("p.field").alias("source_field"))


@query(
    "d8_true_dates",
    on_troubled("SELECT filing_id, std AS standard_date, orig AS original_date, field AS source_field FROM trues",
                *O.results_ctes("troubled")),
)
def d8(spark, sf):
    from ..operators.resolve import all_incident_dates, candidate_array, true_dates

    step = with_fields(X.with_elements(X.troubled_filings(spark, sf)), PACK, only=filter(D.is_date_field, PACK.fields))
    step = step.withColumn("_all", all_incident_dates(candidate_array(PACK.fields, field_column)))
    rows = step.select(
        "filing_id", F.inline(true_dates(F.col("_all"), field_column(V.MULTI_DATE_FIELD))))
    return rows.select("filing_id", "standard_date", "original_date", "source_field")


@query(
    "d9_range",
    on_troubled(f"SELECT {', '.join(RESULT_FIELDS)} FROM results", *O.results_ctes("troubled", COUNTIES)),
)
def d9(spark, sf):
    return results_of(X.troubled_filings(spark, sf)).select(*RESULT_FIELDS)


# ---------------------------------------------------------------- contact block

CONTACT_SQL = "SELECT filing_id, contact FROM filings LEFT JOIN contacts USING (filing_id)"


LAYOUT_FIELDS = ("case_number", "case_type", "judge_name", "filed_date")


@query(
    "f2_layout_table",
    on_filings(f"SELECT filing_id, {', '.join(LAYOUT_FIELDS)} FROM fields", *O.fields_ctes("filings")),
)
def f2_layout(spark, sf):
    filings = X.filings(spark, sf)
    results = extract(
        filings, [PACK.for_counties(ALL_COUNTIES)], outputs=("extracted_data",),
        layout=X.layout_elements(filings), key="filing_id")
    got = [F.try_element_at(F.col("extracted_data"), F.lit(c)).alias(c) for c in LAYOUT_FIELDS]
    return results.select("filing_id", *got)


@query("c1_batch_trigger", on_filings(CONTACT_SQL, *O.contact_ctes("filings")))
def c1(spark, sf):
    return K.add_contact(X.filings(spark, sf), "text", "contact").select("filing_id", "contact")


@query(
    "c2_strict_trigger",
    on_filings(CONTACT_SQL, *O.contact_ctes("filings", V.STRICT_TRIGGERS, False)),
)
def c2(spark, sf):
    rows = K.add_strict_contact(X.filings(spark, sf), "text", "contact", fuzzy=False)
    return rows.select("filing_id", "contact")


# the demand of two thirds of the variants equals a phrase or nearly so; what stands between it and the attorneys is kept
@query(
    "c3_fuzzy_trigger",
    on_filings(
        "SELECT filing_id, CASE WHEN variant IN (0, 1, 3, 4, 6, 7) THEN regexp_extract(text, 'Law Office of [^\n]*', 0) || chr(10)"
        " || regexp_extract(text, 'office[0-9]*@example.com', 0) END AS contact FROM filings"),
)
def c3(spark, sf):
    return K.add_strict_contact(X.filings(spark, sf), "text", "contact").select("filing_id", "contact")


# no line of the prose is near a demand for a jury, and no row may come by chance
@query("c3_fuzzy_trigger_documents", "SELECT doc_id, CAST(NULL AS VARCHAR) AS contact FROM documents")
def c3_documents(spark, sf):
    return K.add_contact(documents(spark, sf), "text", "contact").select("doc_id", "contact")


@query(
    "c4_window",
    on_filings(f"SELECT filing_id, substr(text, idx + 1, {V.CONTACT_WINDOW}) AS near FROM trig",
               *O.contact_ctes("filings")),
)
def c4(spark, sf):
    step = K.add_exact_trigger(X.filings(spark, sf), "text", V.BATCH_TRIGGERS, True)
    near = F.substring("text", F.col("_index") + 1, F.lit(V.CONTACT_WINDOW))
    return step.where(F.col("_index").isNotNull()).select("filing_id", near.alias("near"))


@query("c5_clean", on_filings(f"SELECT filing_id, {O.clean_contact('text')} AS cleaned FROM filings"))
def c5(spark, sf):
    return X.filings(spark, sf).select("filing_id", K.clean_contact(F.col("text")).alias("cleaned"))


@query("c6_clean_layout", f"SELECT doc_id, {O.clean_contact('text', True)} AS cleaned FROM documents")
def c6(spark, sf):
    return documents(spark, sf).select("doc_id", K.clean_contact(F.col("text"), True).alias("cleaned"))


@query("c7_override", on_filings(CONTACT_SQL, *O.contact_ctes("filings")))
def c7(spark, sf):
    step = K.add_contact(X.filings(spark, sf), "text", "_batch")
    step = K.add_strict_contact(step, "text", "_strict")
    contact = K.override_contact(F.col("_strict"), F.col("_batch"))
    return step.select("filing_id", contact.alias("contact"))


# ---------------------------------------------------------------- reports

SUMMARY = (
    "SELECT county, count(*) AS total_files, count(*) FILTER (WHERE error IS NULL) AS successful_extractions,"
    " count(*) FILTER (WHERE error IS NOT NULL) AS failed_extractions,"
    " count(*) FILTER (WHERE incident_date IS NOT NULL AND incident_date <> 'NA') AS incident_dates_found"
    " FROM results GROUP BY county")


def summary(spark, sf):
    return P.summarize(results_of(X.troubled_filings(spark, sf), outputs=SUMMED), "county")


@query("a1_summary", on_troubled(SUMMARY, *O.results_ctes("troubled", COUNTIES)))
def a1(spark, sf):
    return summary(spark, sf)


@query(
    "a2_a3_rates",
    on_troubled(
        "SELECT county, successful_extractions / total_files AS extraction_ratio,"
        " CASE WHEN successful_extractions > 0 THEN incident_dates_found / successful_extractions ELSE 0.0 END AS incident_detection_ratio,"
        " CAST(successful_extractions AS VARCHAR) || '/' || CAST(total_files AS VARCHAR) AS counts"
        f" FROM ({SUMMARY})", *O.results_ctes("troubled", COUNTIES)),
)
def a2(spark, sf):
    rates = P.with_rates(summary(spark, sf))
    counts = F.substring_index("extraction_rate", " ", 1)
    return rates.select("county", "extraction_ratio", "incident_detection_ratio", counts.alias("counts"))


@query(
    "a4_download_stats",
    on_filings(
        "SELECT county, count(*) AS total_available, count(*) FILTER (WHERE filing_id % 3 <> 0) AS successfully_downloaded"
        " FROM filings GROUP BY county"),
)
def a4(spark, sf):
    mapping = X.filings(spark, sf).select(
        "county", F.col("filing_id"), F.col("doc_path").alias("file_name"))
    there = mapping.where("filing_id % 3 <> 0").select("file_name")
    return P.download_stats(mapping, there, "county")


@query(
    "a5_empty_input",
    on_filings(
        "SELECT lower(n_name) || 'county' AS county, coalesce(n, 0) AS total_files, coalesce(d, 0) AS incident_dates_found,"
        " CASE WHEN n IS NULL THEN 'No PDF files found in ' || lower(n_name) || 'county' END AS message FROM nation LEFT JOIN"
        " (SELECT county, count(*) AS n, count(incident_date) AS d FROM results WHERE county NOT LIKE '%2%' GROUP BY county)"
        " ON county = lower(n_name) || 'county'",
        *O.results_ctes("filings", COUNTIES)),
)
def a5(spark, sf):
    counties = X.table(spark, sf, "nation").select(
        F.concat(F.lower("n_name"), F.lit("county")).alias("county"))
    filings = X.filings(spark, sf).where("county NOT LIKE '%2%'")
    rows = P.summary_for_counties(counties, results_of(filings, outputs=SUMMED))
    return rows.select("county", "total_files", "incident_dates_found", "message")


def job_events(spark, sf):
    return X.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts")


JOBS = ("SELECT job_id, status, ts, count(*) OVER () AS total_jobs FROM (SELECT user_id AS job_id, event_type AS status, ts,"
        " row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")


@query("a6_job_list", JOBS)
def a6(spark, sf):
    return P.job_list(job_events(spark, sf))


@query("o1_report", REPORT_SQL)
def o1(spark, sf):
    return P.report_rows(reported(spark, sf))


RESPONSE_SQL = on_troubled(
    "SELECT CAST(filing_id AS VARCHAR) AS case_id, error IS NULL AS extraction_success,"
    " CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status,"
    " error IS NULL AND filing_id % 2 = 1 AS mongodb_updated, error IS NULL AND filing_id % 4 >= 2 AS postgresql_updated,"
    " CASE WHEN error IS NULL THEN 'individual' ELSE 'unknown' END AS county, incident_date, n_dates,"
    " CASE WHEN error IS NOT NULL THEN 'Failed to extract data from Complaint: ' || error"
    " WHEN filing_id % 4 = 0 THEN 'Successfully extracted data from Complaint'"
    " ELSE 'Successfully extracted incident dates, emails, and plaintiff contact for Complaint (Updated: ' ||"
    " CASE filing_id % 4 WHEN 1 THEN 'MongoDB' WHEN 2 THEN 'PostgreSQL' ELSE 'MongoDB & PostgreSQL' END || ')' END AS message"
    " FROM results", *O.results_ctes("troubled"))


@query("o2_response", RESPONSE_SQL)
def o2(spark, sf):
    filings = X.with_elements(X.troubled_filings(spark, sf)).withColumn(
        "pdf_file", TB.base_name(F.col("doc_path")))
    key = F.col("filing_id")
    results = individual_run(filings, PK.individual_pack()).withColumns({
        "case_id": key.cast("string"), "mongo_id": F.lit(None).cast("string"),
        "document_description": F.lit("Complaint"),
        "mongodb_updated": key % 2 == 1, "postgresql_updated": key % 4 >= 2})
    rows = P.response_rows(results)
    return rows.select(
        "case_id", "extraction_success", "status", "database_updates.*", "county", "incident_date",
        F.size("all_incident_dates").cast("long").alias("n_dates"), "message")


# ---------------------------------------------------------------- whole runs and streams


@query(
    "e1_batch_run",
    on_filings(
        f"""SELECT filing_id, {FILE} AS pdf_file, case_id AS mongo_doc_id, doc_path AS original_gcs_path, incident_date, incident_end_date
  FROM results JOIN (SELECT case_id, doc_path AS found FROM case_documents WHERE doc_path IS NOT NULL AND case_id IN
    (SELECT case_id FROM case_documents WHERE court_name = 'Orange County' AND description = 'Initial Complaint')) ON found = doc_path""",
        *O.results_ctes("filings", COUNTIES), X.CASE_DOCUMENTS_CTE),
)
def e1(spark, sf):
    filings = X.with_elements(X.filings(spark, sf))
    results = batch_run(
        cases_of(spark, sf), filings, [PACK.for_counties(COUNTIES)], "orange", "initial complaint")
    return results.select("filing_id", "pdf_file", "mongo_doc_id", "original_gcs_path",
                          "incident_date", "incident_end_date")


@query(
    "e1_batch_job",
    on_filings(
        """SELECT c.case_id, c.idx, c.doc_path, CASE WHEN r.filing_id IS NULL THEN c.incident_date ELSE r.incident_date END AS incident_date,
  r.incident_end_date, r.emails FROM case_documents c LEFT JOIN results r ON r.doc_path = c.doc_path AND c.case_id IN
    (SELECT case_id FROM case_documents WHERE court_name = 'Orange County' AND description = 'Initial Complaint')""",
        *O.results_ctes("filings", COUNTIES), X.CASE_DOCUMENTS_CTE),
)
def e1_job(spark, sf):
    filings = X.with_elements(X.filings(spark, sf))
    job = batch_job(
        cases_of(spark, sf), filings, [PACK.for_counties(COUNTIES)], "orange", "initial complaint",
        shared_folder(spark, "job"), "run")
    return flat_cases(job.cases).select(
        "case_id", "idx", "doc_path", "incident_date", "incident_end_date", "emails")


REQUESTS = """requests AS (SELECT 'case' || CAST(filing_id - filing_id % 4 AS {text}) AS case_id,
  CASE WHEN filing_id % 4 = 0 THEN NULL WHEN filing_id % 4 = 1 THEN lpad(CAST(filing_id AS {text}), 24, 'a')
    WHEN filing_id % 4 = 2 THEN lpad(CAST(filing_id AS {text}), 24, 'z') ELSE CAST(filing_id AS {text}) END AS mongo_id,
  '  ' || doc_path || ' ' AS doc_path, CASE WHEN filing_id % 10 = 0 THEN '' ELSE 'Complaint' END AS document_description
  FROM troubled)"""


@query(
    "e2_individual_job",
    on_troubled(
        "SELECT 'case' || CAST(filing_id - filing_id % 4 AS VARCHAR) AS case_id, doc_path, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END"
        " AS status, error IS NULL AND filing_id % 4 = 1 AS mongodb_updated, error IS NULL AND filing_id % 11 <> 0 AS postgresql_updated,"
        " incident_date, CASE WHEN error IS NOT NULL THEN 'Failed to extract data from Complaint: ' || error"
        " WHEN filing_id % 4 <> 1 AND filing_id % 11 = 0 THEN 'Successfully extracted data from Complaint'"
        " ELSE 'Successfully extracted incident dates, emails, and plaintiff contact for Complaint (Updated: ' ||"
        " CASE WHEN filing_id % 4 <> 1 THEN 'PostgreSQL' WHEN filing_id % 11 = 0 THEN 'MongoDB' ELSE 'MongoDB & PostgreSQL' END || ')'"
        " END AS message FROM results WHERE filing_id % 4 < 2 AND filing_id % 10 <> 0",
        *O.results_ctes("troubled")),
)
def e2_job(spark, sf):
    requests = X.run_sql(
        spark, sf, [X.FILINGS_CTE, X.TROUBLED_CTE, REQUESTS.format(text="STRING")], "SELECT * FROM requests")
    filings = X.with_elements(X.troubled_filings(spark, sf)).select(
        "doc_path", "text", "elements", "county", TB.base_name(F.col("doc_path")).alias("pdf_file"))
    rows, _ = individual_job(requests, filings, PK.individual_pack(), cases_of(spark, sf), shared_folder(spark, "job"))
    return rows.select("case_id", "doc_path", "status", "database_updates.*", "incident_date", "message")


def landed_filings(spark, sf, folder: str, files: int, files_per_batch: int) -> DataFrame:
    """Filings as files in a landing folder, read as a stream; numbers of files are per core, so that each
    micro-batch has tasks for all of them."""
    cores = spark.sparkContext.defaultParallelism
    rows = X.filings(spark, sf).select("filing_id", "county", "doc_path", "text")
    rows.repartition(files * cores, "filing_id").write.parquet(f"{folder}/landing")
    return ST.read_landing(spark, f"{folder}/landing", rows.schema, files_per_batch * cores)


@query(
    "s12_landing_stream",
    on_filings(f"SELECT {', '.join(RESULT_FIELDS)} FROM results", *O.results_ctes("filings", COUNTIES)),
)
def s12(spark, sf):
    folder = shared_folder(spark, "landing")
    rows = ST.extract_stream(landed_filings(spark, sf, folder, 6, 2), [PACK.for_counties(COUNTIES)], outputs=RESULT_FIELDS[2:])
    ST.append_results(rows.select(*RESULT_FIELDS), f"{folder}/results", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/results")


def streamed_filings(spark, sf):
    """Filings whose orders arrive as a stream."""
    schema = spark.read.parquet(f"{sf}/orders.parquet").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    cores = spark.sparkContext.defaultParallelism
    return X.filings(spark, sf, orders=orders.repartition(cores, "o_orderkey"))


@query(
    "t1_stream_extraction",
    on_filings(f"SELECT {', '.join(RESULT_FIELDS)} FROM results", *O.results_ctes("filings", COUNTIES)),
)
def t1(spark, sf):
    folder = shared_folder(spark, "stream")
    rows = ST.extract_stream(X.with_elements(streamed_filings(spark, sf)), [PACK.for_counties(COUNTIES)])
    ST.append_results(rows.select(*RESULT_FIELDS), f"{folder}/results", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/results")


@query(
    "t2_stream_catalog",
    on_filings(
        "SELECT c.case_id, c.idx, coalesce(r.incident_date, c.incident_date) AS incident_date, r.incident_end_date, r.emails,"
        " CASE WHEN r.filing_id IS NOT NULL THEN 'individual_pdf_service' END AS extracted_by FROM case_documents c"
        " LEFT JOIN results r ON r.doc_path = c.doc_path",
        *O.results_ctes("filings", COUNTIES), X.CASE_DOCUMENTS_CTE),
)
def t2(spark, sf):
    folder = shared_folder(spark, "catalog")
    rows = ST.extract_stream(X.with_elements(streamed_filings(spark, sf)), [PACK.for_counties(COUNTIES)])
    key = F.col("filing_id")
    rows = rows.withColumns({
        "case_id": F.concat(F.lit("case"), (key - key % 4).cast("string")),
        "extraction_timestamp": key.cast("string")})
    ST.log_catalog_updates(rows, f"{folder}/updates", f"{folder}/state").awaitTermination()
    updates = spark.read.parquet(f"{folder}/updates")
    merged = flat_cases(ST.catalog_with_updates(cases_of(spark, sf), updates))
    return merged.select("case_id", "idx", "incident_date", "incident_end_date", "emails", "extracted_by")


@query("t2_compacted_log", ORACLES["t2_stream_catalog"])
def t2_compacted(spark, sf):
    folder = shared_folder(spark, "compacted")
    key = F.col("filing_id")
    rows = ST.extract_stream(landed_filings(spark, sf, folder, 6, 2), [PACK.for_counties(COUNTIES)]).withColumns({
        "case_id": F.concat(F.lit("case"), (key - key % 4).cast("string")),
        "extraction_timestamp": key.cast("string")})
    ST.log_catalog_updates(rows, f"{folder}/updates", f"{folder}/state").awaitTermination()
    ST.compact_updates(spark, f"{folder}/updates")
    updates = spark.read.parquet(f"{folder}/updates")
    merged = flat_cases(ST.catalog_with_updates(cases_of(spark, sf), updates))
    return merged.select("case_id", "idx", "incident_date", "incident_end_date", "emails", "extracted_by")


@query("t3_stream_jobs", JOBS.replace(", count(*) OVER () AS total_jobs", ""))
def t3(spark, sf):
    folder = shared_folder(spark, "jobs")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events = events.select(
        "event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts")
    ST.log_job_status(events, f"{folder}/log", f"{folder}/state").awaitTermination()
    return ST.latest_job_status(spark.read.parquet(f"{folder}/log"))
