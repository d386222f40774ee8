"""The case catalog: search, document paths, file mapping, nested updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import blank_to_null, let

VALUE_FIELDS = ("incident_date", "incident_end_date", "emails", "plaintiff_contact")
DOCUMENT_TYPE = (
    "struct<doc_path:string,description:string,incident_date:string,incident_end_date:string,"
    "emails:string,plaintiff_contact:string,extraction_timestamp:string,extracted_by:string>"
)


def find_cases(cases: DataFrame, county: str, document_type: str) -> DataFrame:
    """Cases of a county with at least one document of the type (both regexes, case ignored)."""
    return cases.where(
        F.rlike("court_name", F.lit("(?i)" + county))
        & F.exists("documents", lambda d: F.rlike(d["description"], F.lit("(?i)" + document_type)))
    )


def document_paths(cases: DataFrame) -> DataFrame:
    """``(case_id, idx, doc_path)`` of *all* documents of the given cases that have a path."""
    return (
        cases.select("case_id", F.posexplode("documents.doc_path").alias("idx", "doc_path"))
        .where(F.length("doc_path") > 0)
    )


def in_date_window(date_from: Column, date_to: Column, day: Column) -> Column:
    start = default_date_from(date_from, date_to)
    return day.between(start, date_to)


def default_date_from(date_from: Column, date_to: Column) -> Column:
    return F.coalesce(date_from, F.date_sub(date_to, V.DEFAULT_WINDOW_DAYS))


def local_name(doc_path: Column) -> Column:
    """Local file name of a path; NULL when the path has fewer than four parts."""
    parts = F.split(doc_path, "/", -1)
    case_number = F.replace(F.get(parts, F.lit(1)), F.lit("-"), F.lit("_"))
    return F.concat(case_number, F.lit("_"), F.get(parts, F.lit(3)))


def build_mapping(documents: DataFrame, order: list[str]) -> DataFrame:
    """One row per local name; the last one in catalog order wins.

    A max-by aggregate combines on the map side, so a name shared by very many
    documents costs one row per task.
    """
    named = documents.withColumn("file_name", local_name(F.col("doc_path")))
    last = F.max_by(F.struct("doc_id", "doc_path", *order), F.struct(*order))
    return (
        named.where(F.col("file_name").isNotNull())
        .groupBy("file_name")
        .agg(last.alias("last"))
        .select(
            "file_name", "last.doc_id", F.col("last.doc_path").alias("original_path"),
            *[F.col(f"last.{c}").alias(c) for c in order],
        )
    )


def look_up_files(names: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """``(pdf_file, mongo_doc_id, original_gcs_path)`` of the distinct names that a mapping key fits.

    An exact hit wins.  Otherwise the first key (by ``order``) that the name
    ends with: the name's suffixes, at the lengths keys really have, meet the keys
    in one equi-join; the whole name is one of them.
    """
    keys = mapping.select(
        F.col("file_name").alias("key"), F.col("doc_id").alias("mongo_doc_id"),
        F.col("original_path").alias("original_gcs_path"), F.col(order).alias("_order"),
    )
    # at most as many lengths as a file name has characters
    lengths = keys.select(F.collect_set(F.length("key"))).scalar()
    suffixes = (
        names.select("pdf_file").distinct()
        .select("pdf_file", F.explode(lengths).alias("n"))
        .where(F.col("n") <= F.length("pdf_file"))
        .select("pdf_file", F.right(F.col("pdf_file"), F.col("n")).alias("key"))
    )
    rank = F.struct((F.col("key") != F.col("pdf_file")).alias("longer"), "_order")
    return (
        suffixes.join(keys, "key")
        .groupBy("pdf_file")
        .agg(F.min_by(F.struct("mongo_doc_id", "original_gcs_path"), rank).alias("first"))
        .select("pdf_file", "first.*")
    )


def map_files(files: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """Add ``mongo_doc_id`` and ``original_gcs_path`` by file name; names are looked up once each, however often they occur."""
    return files.join(look_up_files(files, mapping, order), "pdf_file", "left")


def has_values(df: DataFrame) -> DataFrame:
    """Keep results with at least one non-empty value to write."""
    filled = [blank_to_null(F.col(c)) for c in VALUE_FIELDS]
    return df.where(F.coalesce(*filled).isNotNull())


def valid_catalog_id(mongo_id: Column) -> Column:
    return F.coalesce(F.length(mongo_id) == V.CATALOG_ID_LENGTH, F.lit(False))


def parse_documents(documents_json: Column) -> Column:
    """Documents array from JSON text; NULL when missing or malformed."""
    return F.from_json(documents_json, f"array<{DOCUMENT_TYPE}>", {"mode": "PERMISSIVE"})


def documents_problem(documents_json: Column) -> Column:
    """Why a case row cannot be updated; NULL when it can."""
    empty = documents_json.isNull() | (documents_json == "")
    return F.when(empty, F.lit("no documents")).when(
        parse_documents(documents_json).isNull(), F.lit("invalid JSON")
    )


def split_catalog(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases whose JSON text of documents can be read, and the others with the ``reason`` why not.

    Readable ones keep their text and get ``documents`` decoded, beside ``elements``: the text of each document.
    """
    told = cases.withColumn("reason", documents_problem(F.col("documents")))
    good = told.where(F.col("reason").isNull()).drop("reason").withColumns(
        {
            "elements": F.from_json("documents", "array<string>"),
            "documents": parse_documents(F.col("documents")),
        }
    )
    return good, told.where(F.col("reason").isNotNull())


def update_json_store(
    cases: DataFrame, results: DataFrame, order: str = "extraction_timestamp"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The individual update over a store that holds documents as JSON text.

    Returns the readable cases with their text written anew, one status row per (case, path), and the quarantine:
    unreadable cases with the reason, as they were.  Keys that the library does not know stay in a document; a
    document that no result names keeps its text to the letter.  Results of an unreadable case have the reason as status.
    """
    good, bad = split_catalog(cases)
    located = locate(good, has_values(results), order)
    known = [*VALUE_FIELDS, "extraction_timestamp", "extracted_by"]

    def change(old, new):
        # variants, so that numbers and arrays under other keys stay what they are
        fields = F.from_json(old, "map<string,variant>")
        values = [
            F.coalesce(blank_to_null(new[c]), F.try_element_at(fields, F.lit(c)).cast("string")).cast("variant")
            for c in VALUE_FIELDS
        ]
        values += [new[order].cast("string").cast("variant"), F.lit(V.EXTRACTED_BY).cast("variant")]
        others = F.map_filter(fields, lambda k, _: ~k.isin(*known))
        return F.to_json(F.map_concat(others, F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*values))))

    texts = rewrite(good.select("case_id", F.col("elements").alias("documents")), located, change)
    written = F.concat(F.lit("["), F.array_join("documents", ","), F.lit("]"))
    texts = texts.select("case_id", F.when(F.col("_touched"), written).alias("_text"))
    kept = [c for c in cases.columns if c != "documents"]
    new = cases.join(texts, "case_id").select(*kept, F.coalesce("_text", "documents").alias("documents"))
    reasons = bad.select("case_id", "reason")
    status = update_status(located).join(reasons, "case_id", "left")
    return new, status.select("case_id", "doc_path", F.coalesce("reason", "status").alias("status")), bad


def touched_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """The cases that results speak of."""
    return cases.join(results.select("case_id").distinct(), "case_id", "left_semi")


def _first_slots(cases: DataFrame) -> DataFrame:
    """First place of each path inside its case: ``(case_id, doc_path, idx, old)``.

    Places are reduced by (case, path), the keys that results meet them on, so a case with very many
    documents takes time in proportion.
    """
    old = [F.col(f"d.{c}").alias(f"old_{c}") for c in VALUE_FIELDS]
    places = cases.select("case_id", F.posexplode("documents").alias("idx", "d")).select(
        "case_id", F.col("d.doc_path").alias("doc_path"), F.struct("idx", *old).alias("place")
    )
    return (
        places.where(F.col("doc_path").isNotNull())
        .groupBy("case_id", "doc_path")
        .agg(F.min_by("place", "place.idx").alias("first"))
        .select("case_id", "doc_path", "first.*")
    )


def locate(cases: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """Latest result per (case, path) and its place in the catalog (NULL if none).

    Only documents of touched cases are listed.  They meet results on (case, path), so one case with very many
    results spreads out, and only results which have a place are gathered per case afterwards.  What is returned
    feeds both the new catalog and the status rows: store it once.
    """
    latest = (
        results.groupBy("case_id", "doc_path")
        .agg(F.max_by(F.struct(*VALUE_FIELDS, order), order).alias("new"))
    )
    return latest.join(_first_slots(touched_cases(cases, latest)), ["case_id", "doc_path"], "left")


def _merged(documents: Column, updates: Column, change) -> Column:
    """Documents with ``change(document, new)`` where an update names their place; updates are ``struct<idx, new>``.

    Places of both kinds are sorted together, so an update stands right before its document: no search per document.
    """
    def place(idx, kind, at):
        return F.struct(idx.alias("idx"), F.lit(kind).alias("kind"), at.alias("at"))

    both = F.concat(
        F.transform(updates, lambda u, k: place(u["idx"], 0, k)), F.transform(documents, lambda d, i: place(i, 1, i))
    )

    def rewrite(places):
        def one(p, k):
            before = F.get(places, k - 1)
            hit = (p["kind"] == 1) & (before["kind"] == 0) & (before["idx"] == p["idx"])
            return F.struct(p["kind"].alias("kind"), p["at"].alias("at"), F.when(hit, before["at"]).alias("update"))

        own = F.filter(F.transform(places, one), lambda p: p["kind"] == 1)

        def found(p):
            return F.struct(F.get(documents, p["at"]).alias("old"), F.get(updates, p["update"])["new"].alias("new"))

        return F.transform(
            F.transform(own, found), lambda x: F.when(x["new"].isNotNull(), change(x["old"], x["new"])).otherwise(x["old"])
        )

    return let(F.array_sort(both), rewrite)


def rewrite(cases: DataFrame, located: DataFrame, change) -> DataFrame:
    """Cases with their located results written in by ``change``, and ``_touched``."""
    updates = (
        located.where(F.col("idx").isNotNull())
        .groupBy("case_id")
        .agg(F.collect_list(F.struct("idx", "new")).alias("_updates"))
    )
    joined = cases.join(updates, "case_id", "left")
    touched = F.col("_updates").isNotNull()
    merged = _merged(F.col("documents"), F.col("_updates"), change)
    return joined.withColumn(
        "documents", F.when(touched, merged).otherwise(F.col("documents"))
    ).withColumn("_touched", touched).drop("_updates")


def set_values(document: Column, new: Column) -> Column:
    """The four values, also where they are NULL."""
    for c in VALUE_FIELDS:
        document = document.withField(c, new[c])
    return document


def update_status(located: DataFrame) -> DataFrame:
    """``updated``, ``unchanged`` or ``not_found`` per (case, path)."""
    same = F.lit(True)
    for c in VALUE_FIELDS:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new.{c}"))
    status = (
        F.when(F.col("idx").isNull(), F.lit("not_found"))
        .when(same, F.lit("unchanged"))
        .otherwise(F.lit("updated"))
    )
    return located.select("case_id", "doc_path", status.alias("status"))


def update_batch(
    cases: DataFrame, results: DataFrame, order: str, located: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Set the four values of the first document with the path, also to NULL.

    Returns the new catalog and one status row per (case, path): ``updated``,
    ``unchanged`` or ``not_found``.  A caller that uses both passes a stored ``located``.
    """
    located = locate(cases, results, order) if located is None else located
    return rewrite(cases, located, set_values).drop("_touched"), update_status(located)


def update_individual(
    cases: DataFrame, results: DataFrame, order: str = "extraction_timestamp", updated_at=None,
    located: DataFrame | None = None,
) -> DataFrame:
    """Overwrite with non-empty values only; stamp the document and the case."""
    located = locate(cases, has_values(results), order) if located is None else located

    def change(old, new):
        d = old
        for c in VALUE_FIELDS:
            d = d.withField(c, F.coalesce(blank_to_null(new[c]), old[c]))
        return d.withField("extraction_timestamp", new[order].cast("string")).withField(
            "extracted_by", F.lit(V.EXTRACTED_BY)
        )

    stamp = F.current_timestamp() if updated_at is None else updated_at
    new_cases = rewrite(cases, located, change)
    old = F.col("updated_at") if "updated_at" in cases.columns else F.lit(None).cast("timestamp")
    return new_cases.withColumn(
        "updated_at", F.when(F.col("_touched"), stamp).otherwise(old)
    ).drop("_touched")


def updated_stores(batch_updated: Column, individual_updated: Column) -> Column:
    """Names of the updated stores joined with ``' & '``; ``''`` if none."""
    first, second = V.STORE_NAMES
    named = F.array(
        F.when(batch_updated, F.lit(first)), F.when(individual_updated, F.lit(second))
    )
    return F.array_join(F.array_compact(named), " & ")
