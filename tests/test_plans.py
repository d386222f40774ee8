"""Plans of the extraction, places of matches in long texts, updates, jobs, stores and streams."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from docketry.functions import dates as D
from docketry.functions import regex as R
from docketry.functions import text as N
from docketry.operators import catalog as C
from docketry.operators import report as P
from docketry.operators.contact import add_contact
from docketry.operators.resolve import true_dates
from docketry.operators.rules import Doc, emails, rule_column, shared_of
from docketry.plans.extract import RESULT_COLUMNS, extract, with_fields
from docketry.plans.runs import batch_job
from docketry.registry.queries import PACK, QUERIES, REPORTED, landed_filings, nested_cases
from docketry.session import shared_folder
from docketry.sources import sinks as SK
from docketry.streaming import jobs as ST

TEXT = "On or about May 3, 2020 a fall.\nFiled: 05/07/2020\nJury Trial Demanded\nLaw Office of A\na@b.org\n"


@pytest.fixture(scope="module")
def filings(spark):
    path = shared_folder(spark, "filings")
    counties = [f"c{i}" for i in range(62)]
    rows = [(i, c, TEXT + f"The incident happened on June {i % 28 + 1}, 2021.") for i, c in enumerate(counties)] + [(99, None, TEXT), (100, "c1", None)]
    spark.createDataFrame(rows, "id int, county string, text string").write.parquet(path)
    return spark.read.parquet(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_each_text_is_searched_once(spark):
    texts = spark.range(4).select(F.expr("CASE id WHEN 0 THEN 'a@b.org' WHEN 1 THEN '' WHEN 2 THEN 'no' END").alias("text"))
    assert [r[0] for r in texts.select(N.filled(F.col("text"))).collect()] == ["a@b.org", None, "no", None]
    found = texts.select(emails(F.col("text")).alias("found"))
    assert [r.found for r in found.collect()] == ["a@b.org", None, None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_only_asked_outputs_are_planned(filings):
    packs = [PACK.for_counties(["c1", "c2"])]
    nothing = plan_of(extract(filings, packs, outputs=()).select("county"))
    assert not re.search("Generate|ArrowEvalPython|regexp|RLIKE", nothing)
    dates = plan_of(extract(filings, packs, outputs=("incident_date", "error")))
    assert "ArrowEvalPython" not in dates and "field_plaintiff" not in dates and dates.count("Generate") == 1
    pruned = plan_of(extract(filings, packs).select("incident_date"))
    assert "ArrowEvalPython" not in pruned and "field_plaintiff" not in pruned
    with pytest.raises(ValueError):
        extract(filings, packs, outputs=("no_such",))


def test_outputs_do_not_change_values(filings):
    packs = [PACK.for_counties(["c1", "c2"])]
    whole = {r["id"]: r for r in extract(filings, packs).collect()}
    for outputs in (("incident_date", "error"), ("emails",), ("extracted_data",), ("all_incident_dates", "plaintiff_contact")):
        for r in extract(filings, packs, outputs=outputs).collect():
            assert all(r[c] == whole[r["id"]][c] for c in outputs)
    assert set(RESULT_COLUMNS) <= set(whole[1].asDict())


def _variants(n):
    """Packs that differ in rules and in order: some words of their own, some rules shared by all."""
    out = []
    for i in range(n):
        rules = {f: PACK.rules[f] for f in ("numeric_date", "facts_date_2", "multiple_dates_extractor")}
        if i % 3:
            rules["numeric_date"] = {"type": "regex", "regex": rf"\d{{1,2}}/\d{{1,2}}/20\d{{1,{2 + i % 3}}}"}
        order = tuple(rules) if i % 2 else tuple(reversed(rules))
        out.append(type(PACK)((f"c{i}",), rules, order))
    return out


def test_sixty_packs_read_the_table_once(filings):
    packs = _variants(60)
    together = extract(filings, packs)
    assert len(re.findall(r"FileScan", plan_of(together))) == 1
    got = {r["id"]: r for r in together.collect()}
    assert got[99]["county"] == "unknown" and got[99]["extracted_data"] == {}
    for i in (0, 1, 2, 3, 4, 5, 59, 61):
        alone = extract(filings.where(F.col("id") == i), packs[i : i + 1]).first()
        assert got[i] == alone


def test_first_pack_of_a_county_wins(filings):
    one, other = _variants(2)
    got = extract(filings, [one, other.for_counties(["c0", "c1"])], outputs=("extracted_data",))
    assert got.count() == filings.count()
    assert list(got.where("id = 0").first()["extracted_data"]) == [f for f in one.order]


def test_county_of_the_job(filings):
    rows = extract(filings, [PACK.for_counties(["x"])], county="x", extracted_at=F.lit("t")).collect()
    assert {r["county"] for r in rows} == {"x"} and {r["extraction_timestamp"] for r in rows} == {"t"}
    assert all(r["incident_date"] for r in rows if r["error"] is None)


def test_words_a_pattern_holds():
    assert R.held_literals(r"(?i)on or about\s+(May|June)\s+\d") == [("on or about",), ("may", "june")]
    assert R.held_literals(r"(ab)?c+d*(?:e|fg)") == [("c",), ("e", "fg")]
    assert R.held_literals(r"a|b?") == []
    shape = r"(?:May|June)\s+\d{1,2}"
    assert R.holds_match_of(r"on ((?:May|June)\s+\d{1,2}), x", shape) and not R.holds_match_of(r"(?:May|June)\s+\d{1,3}", shape)
    assert R.same_matches(rf"({shape})", shape) and not R.same_matches(r"(May|June)\s+\d{1,2}", shape)
    assert R.has_sure_group(r"on (May|June)") and not R.has_sure_group(r"on (May)?") and not R.has_sure_group(r"(a)|b")


AWKWARD = ["", "no date", "ON OR ABOUT MAY 3, 2020", "İncident occurred on May 3, 2020", "auguſt 5, 2020 on auguſt 5, 2020", "on\nMay\n3,\n2020", "incıdent on or about June 1, 2021 9/9/1999",
           "￿ May 4, 2020 ￿ and 1/2/2003", "date of the accident: 1/2/2003", "K May 1, 2020 occurred on May 1, 2020 facts happened"]


@pytest.mark.parametrize("field", [f for f in PACK.fields if PACK.rules[f]["type"] not in ("nearest_word", "section_pattern", "case_title")])
def test_shared_words_change_nothing(spark, field):
    rule = PACK.rules[field]
    shared = shared_of([rule])
    d = spark.createDataFrame([(t,) for t in AWKWARD * 2], "_text string").withColumn("_lower", F.lower("_text"))
    alone = rule_column(rule, Doc(F.col("_text"), F.col("_lower")))
    for step in shared.columns():
        d = d.withColumns(step)
    together = rule_column(rule, Doc(F.col("_text"), F.col("_lower"), None, shared))
    for r in d.select("_text", alone.alias("a"), together.alias("b")).collect():
        assert r["a"] == r["b"], r["_text"]


def timed(spark, make, text):
    d = spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("v"))
    d.collect()
    began = time.perf_counter()
    value = d.collect()[0]["v"]
    return time.perf_counter() - began, value


DATED = "On May 1, 2020 the incident é happened and 1/2/2003 passed.\n"


@pytest.mark.parametrize("make", [
    lambda t: F.size(R.match_spans(t, r"(?:May|June)\s+\d{1,2}", r"\d/\d")),
    lambda t: F.size(N.lines_with_offsets(t)),
    *[lambda t, f=f: rule_column(PACK.rules[f], Doc(t, F.lower(t))) for f in ("contextual_incident_search", "advanced_incident_date", "multiple_dates_extractor")],
], ids=["spans", "lines", "contextual", "scored", "dates"])
def test_time_grows_with_the_text(spark, make):
    short, long = (timed(spark, make, DATED * (n // len(DATED)))[0] for n in (100_000, 800_000))
    assert long < 1 + 16 * short, (short, long)


def test_places_in_long_texts(spark):
    text = DATED * 3000
    got = timed(spark, lambda t: R.match_spans(t, r"May\s+\d", r"\d/\d"), text)[1]
    want = [(i, m.start(), m.group()) for i, p in enumerate((r"May\s+\d", r"\d/\d")) for m in re.finditer(p, text)]
    assert [(s["pattern"], s["start"], s["value"]) for s in got] == want
    rows = timed(spark, N.lines_with_offsets, text)[1]
    assert [r["offset"] for r in rows] == [i * len(DATED) for i in range(3001)]


def test_running_totals_and_page_windows(spark):
    for numbers in ([], [5], [1, 2, 3], list(range(100))):
        got = spark.createDataFrame([(numbers,)], "a array<int>").select(N.running_totals(F.col("a"))).first()[0]
        assert got == [sum(numbers[: i + 1]) for i in range(len(numbers))]
    text = "".join(chr(200 + i % 300) for i in range(3000))
    spans = [(-5, 10), (0, 0), (1020, 1030), (1024, 2048), (2990, 4000), (10, 5), (3000, 3010), (5000, 5100)]
    d = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a int, b int")
    for r in d.select("a", "b", N.page_window(N.pages(F.col("t")), F.col("a"), F.col("b")).alias("v")).collect():
        assert r["v"] == text[max(r["a"], 0) : max(r["b"], max(r["a"], 0))]


def test_windows_are_cut_once(spark):
    d = spark.createDataFrame([(TEXT,)], "t string")
    doc = Doc(F.col("t"), F.col("t"))
    for field, lowered in (("advanced_incident_date", 1), ("contextual_incident_search", 1)):
        plan = d.select(rule_column(PACK.rules[field], doc).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(") == lowered, field
    text = "0123456789é" * 40  # one page
    spans = [(-5, 10), (0, 0), (430, 450), (10, 5), (440, 500), (1020, 1030), (2000, 3000)]
    rows = spark.createDataFrame([(t, a, b) for t in (text, "") for a, b in spans], "t string, a int, b int")
    for r in rows.select("t", "a", "b", N.page_window(N.pages(F.col("t")), F.col("a"), F.col("b")).alias("v")).collect():
        assert r["v"] == r["t"][max(r["a"], 0) : max(r["b"], max(r["a"], 0))]


def test_pages_are_cut_once_per_text(filings):
    found = extract(filings, [PACK.for_counties(["c1", "c2"])], outputs=("incident_date", "error"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?s).{1,1024}") == 1


def test_likely_texts_are_searched_once(spark):
    d = spark.createDataFrame([(t,) for t in ("", "none", "on May 1", "a on May 1 b", "On May 1on May 22 é on May 3 ", "on May 1" * 9, "x\uffffon May 1", None)], "t string")
    pattern = r"on\s+(May \d+)"
    for likely in (False, True):
        spans = R.match_spans(F.col("t"), pattern, first=2, likely=likely)
        for r in d.select("t", spans.alias("s")).collect():
            want = None if r["t"] is None else [(2, m.start(), m.group(), m.group(1)) for m in re.finditer(pattern, r["t"], re.IGNORECASE)]
            assert (None if r["s"] is None else [tuple(x) for x in r["s"]]) == want
    # texts of the words that a pattern holds are not asked by it first
    shared = shared_of([{"type": "regex", "regex": pattern}])
    doc = Doc(F.col("t"), F.col("t"), None, shared)
    assert "RLIKE" not in str(doc.spans(pattern)).upper()


def test_pages_of_short_and_long_texts(spark):
    texts = ["", "a", "é" * 600, "x" * 1024, "y" * 1025, "\U0001f600" * 1025, None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in d.select(N.pages(F.col("t"))).collect()]
    assert got == [None if t is None else [t[i : i + N.PAGE] for i in range(0, len(t), N.PAGE)] for t in texts]
    plan = d.select(N.pages(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan  # short texts are not searched


def test_best_group_searches_once_inside_lambdas(spark):
    d = spark.createDataFrame([(["on May 3, 2020 and May 4, 2021", "nothing", "", None],)], "a array<string>")
    for pattern, want in ((r"on\s+(May|June|July|April)\s+\d", ["May", None, None, None]), (r"May\s+\d+", ["May 3", None, None, None])):
        found = d.select(F.transform("a", lambda x: R.best_group(x, pattern)).alias("v"))
        assert found.first()["v"] == want
        assert len(re.findall(r"regexp_extract(?:_all)?\(", found._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_primary_candidate_is_picked_once(spark, sf):
    plan = QUERIES["d7_primary"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("advanced_incident_date, value") == 1


def test_dates_merge_without_pairs(spark):
    own = "array<struct<original_date:string,standard_date:string,source_field:string,is_incident:boolean>>"
    dates = [("b", "2020-01-02", "f", True), ("a", "2020-01-01", "f", True), ("c", "2020-01-02", "g", True), ("z", "2019-01-01", "g", False)]
    multi = "January 2, 2020 | May 5, 2021 (x) | May 5, 2021 | 01/01/2001 | January 3, 2020"
    d = spark.createDataFrame([(dates, multi)], f"d {own}, m string").select(true_dates(F.col("d"), F.col("m")).alias("v"))
    assert [(x["standard_date"], x["original_date"]) for x in d.first()["v"]] == [
        ("2020-01-01", "a"), ("2020-01-02", "b"), ("2020-01-02", "c"), ("2020-01-03", "January 3, 2020"), ("2021-05-05", "May 5, 2021 (x)")]


RESULT = "case_id string, doc_path string, incident_date string, incident_end_date string, emails string, plaintiff_contact string, extraction_timestamp string"


def catalog(spark, sizes):
    rows = [(c, "Court", i, f"p{i // 2}", "d", None) for c, n in sizes.items() for i in range(n)]
    return nested_cases(spark.createDataFrame(rows, "case_id string, court_name string, idx int, doc_path string, description string, incident_date string"))


def test_untouched_cases_are_not_listed(spark):
    cases = catalog(spark, {f"c{i}": 3 for i in range(50)} | {"big": 20_000})
    results = spark.createDataFrame([("c3", "p1", "new", None, None, None, "1"), ("big", "p9999", "last", None, None, None, "1"), ("c4", "none", "x", None, None, None, "1")], RESULT)
    located = C.locate(cases, results, "extraction_timestamp")
    assert plan_of(located).index("LeftSemi") > plan_of(located).index("Generate")
    new, status = C.update_batch(cases, results, "extraction_timestamp", located)
    dates = {r["case_id"]: [d["incident_date"] for d in r["documents"]] for r in new.collect()}
    assert dates["c3"] == [None, None, "new"] and dates["c4"] == [None] * 3
    assert dates["big"] == [None] * 19_998 + ["last", None] and sum(any(x) for x in dates.values()) == 2
    assert {tuple(r) for r in status.collect()} == {("c3", "p1", "updated"), ("big", "p9999", "updated"), ("c4", "none", "not_found")}


def test_json_store(spark):
    stored = [("a", '[{"doc_path":"p", "n": 1, "m": [1, {"k": null}], "incident_date":"old"},  {"doc_path":"q","x":[1]}]'), ("b", "[{"), ("c", None), ("d", '[{"doc_path":"p"}]')]
    cases = spark.createDataFrame([(*r, 7) for r in stored], "case_id string, documents string, more int")
    results = spark.createDataFrame([("a", "p", "", "end", None, None, "5"), ("b", "p", "x", None, None, None, "5"), ("a", "none", "x", None, None, None, "5")], RESULT)
    new, status, bad = C.update_json_store(cases, results)
    texts = {r["case_id"]: r["documents"] for r in new.collect()}
    assert set(texts) == {"a", "d"} and texts["d"] == stored[3][1]
    first, second = json.loads(texts["a"])
    assert first["incident_date"] == "old" and first["incident_end_date"] == "end" and first["n"] == 1 and first["m"] == [1, {"k": None}] and first["extracted_by"]
    assert second == {"doc_path": "q", "x": [1]}
    assert {(r["case_id"], r["status"]) for r in status.collect()} == {("a", "updated"), ("a", "not_found"), ("b", "invalid JSON")}
    assert {(r["case_id"], r["reason"], r["more"]) for r in bad.collect()} == {("b", "invalid JSON", 7), ("c", "no documents", 7)}


def test_batch_job(spark):
    cases = nested_cases(spark.createDataFrame(
        [("k", "Orange County", 0, "x/1-2/d/a.pdf", "Complaint", None), ("m", "Lake", 0, "x/3-4/d/b.pdf", "Complaint", None)],
        "case_id string, court_name string, idx int, doc_path string, description string, incident_date string"))
    rows = spark.createDataFrame([("x/1-2/d/a.pdf", "x", TEXT), ("x/3-4/d/b.pdf", "x", TEXT)], "doc_path string, county string, text string")
    folder = shared_folder(spark, "job")
    for _ in range(2):  # a second try replaces what the first one wrote
        job = batch_job(cases, rows, [PACK.for_counties(["x"])], "orange", "complaint", folder, "r1")
    assert [(r["pdf_file"], r["mongo_doc_id"]) for r in job.results.collect()] == [("1_2_a.pdf", "k")]
    assert [r["status"] for r in job.status.collect()] == ["updated"]
    assert {r["case_id"]: r["documents"][0]["emails"] for r in job.cases.collect()} == {"k": "a@b.org", "m": None}
    assert job.summary.first()["extraction_rate"] == "1/1 (100.0%)"
    assert spark.read.json(f"{folder}/documents").count() == spark.read.json(f"{folder}/batch").count() == 1
    assert spark.read.option("header", True).csv(f"{folder}/report").first()["Status"] == "Success"


def test_batch_run_extracts_once(spark):
    from docketry.plans.runs import batch_run

    cases = catalog(spark, {"c": 2})
    rows = spark.createDataFrame([("p0", "x", TEXT)], "doc_path string, county string, text string")
    assert plan_of(batch_run(cases, rows, [PACK.for_counties(["x"])], "court", "d")).count("ArrowEvalPython") == 1


def test_files_follow_rows(spark):
    rows = spark.range(10_000).select(F.col("id").cast("string").alias("pdf_file"), F.when(F.col("id") < 9000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("county"))
    path = shared_folder(spark, "clustered")
    SK.write_per_document_json(rows, path, rows_per_file=1000)
    back = spark.read.json(path)
    assert back.count() == 10_000
    files = {r["county"]: r["n"] for r in back.select("county", F.input_file_name().alias("f")).distinct().groupBy("county").agg(F.count("f").alias("n")).collect()}
    assert 3 <= files["big"] <= 18 and all(files[f"s{i}"] == 1 for i in range(3))


def test_landing_stream_restarts(spark):
    """A query killed between micro-batches goes on where it stopped: no row lost or doubled."""
    folder, schema = shared_folder(spark, "land"), "id long, county string, text string"
    for i in range(6):
        spark.createDataFrame([(i * 10 + j, "x", TEXT) for j in range(10)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = ST.extract_stream(ST.read_landing(spark, f"{folder}/in", schema, 1), [PACK.for_counties(["x"])], outputs=("incident_date", "error"))
    assert "Exchange" not in plan_of(extract(spark.read.schema(schema).parquet(f"{folder}/in"), [PACK.for_counties(["x"])], outputs=("incident_date", "error")))
    seen = []

    def write(batch, batch_id):
        if len(seen) == 2 and batch_id not in seen:
            seen.append(batch_id)
            raise RuntimeError("killed")
        seen.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    def run():
        query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run()
    assert spark.read.parquet(f"{folder}/out").count() == 20
    run()
    out = spark.read.parquet(f"{folder}/out")
    assert sorted(r["id"] for r in out.collect()) == list(range(60)) and len(seen) > 6


def test_landed_files_give_work_to_all_cores(spark, sf):
    folder, cores = shared_folder(spark, "landed"), spark.sparkContext.defaultParallelism
    stream = landed_filings(spark, sf, folder, 6, 2)
    files = spark.read.parquet(f"{folder}/landing").inputFiles()
    assert len(files) == 6 * cores
    batches = []
    query = stream.writeStream.foreachBatch(lambda batch, _: batches.append((batch.select(F.input_file_name()).distinct().count(), batch.count()))).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [n for n, _ in batches] == [2 * cores] * 3 and sum(n for _, n in batches) == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_compacted_log(spark):
    path, write = shared_folder(spark, "log"), None
    write = ST._to_batch_partition(path)
    for n in range(4):
        write(spark.createDataFrame([("c", f"p{i}", f"d{n}", None, None, None, str(n)) for i in range(n, 5)], RESULT), n)
    cases = catalog(spark, {"c": 10, "e": 2})

    def merged():
        return ST.catalog_with_updates(cases, spark.read.parquet(path)).drop("updated_at").orderBy("case_id").collect()

    before = merged()
    assert ST.compact_updates(spark, path, keep=1) == 3 and merged() == before
    assert spark.read.parquet(path).count() == 5 + 2
    write(spark.createDataFrame([("c", "p0", "d9", None, None, None, "9")], RESULT), 4)
    later = merged()
    ST.compact_updates(spark, path)
    ST.compact_updates(spark, path)
    assert merged() == later and spark.read.parquet(path).count() == 5


def test_job_log_keeps_no_state(spark):
    folder, schema = shared_folder(spark, "jobs"), "event_id long, job_id long, status string, ts long"
    spark.createDataFrame([(i, i % 3, f"s{i}", i) for i in range(9)], schema).write.parquet(f"{folder}/in")
    query = ST.log_job_status(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/log", f"{folder}/state")
    query.awaitTermination()
    assert query.lastProgress is None or not query.lastProgress["stateOperators"]
    rows = ST.latest_job_status(spark.read.parquet(f"{folder}/log")).collect()
    assert {(r["job_id"], r["status"]) for r in rows} == {(0, "s6"), (1, "s7"), (2, "s8")}


def test_element_table_gives_the_rows_of_the_array(spark):
    lines = ["Case Number:", "2020-CA-1", "Judge:", "Ann", "Lee", "x", "Filed:"]
    rows = [(d, "x" if d % 2 else "y", TEXT if d else None, [(0, i, w, 70.0 + 50 * (i % 3), 100.0 + 50 * (i % 3), 700.0 - 12 * (i // (d + 2))) for i, w in enumerate(lines)]) for d in range(4)]
    kind = "array<struct<page:int,elem_idx:int,text:string,x0:double,x1:double,y0:double>>"
    d = spark.createDataFrame(rows, f"id int, county string, text string, elements {kind}")
    other = type(PACK)(("y",), {"case_number": {**PACK.rules["case_number"], "extract_words": 2}}, ("case_number",))
    packs = [PACK.for_counties(["x"]), other]
    array = extract(d, packs).orderBy("id").collect()
    table = extract(d.drop("elements"), packs, layout=d.select("id", F.inline("elements")), key="id").orderBy("id").collect()
    assert [r.asDict() for r in table] == [r.asDict() for r in array]
    assert sum("case_number" in (r["extracted_data"] or {}) for r in array) >= 2


@pytest.mark.parametrize("name", ["d7_primary", "d8_true_dates"])
def test_dates_ask_for_date_rules_alone(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "field_multiple_dates_extractor" in plan and "field_case_number" not in plan and "field_plaintiff" not in plan


def test_report_asks_for_date_rules_alone(spark, sf, filings):
    assert "field_plaintiff" not in plan_of(QUERIES["o1_report"](spark, sf))
    packs = [PACK.for_counties(["c1", "c2"])]
    named = filings.withColumns({"pdf_file": F.col("id").cast("string"), "mongo_doc_id": F.lit("x")})
    whole = extract(named, packs)
    few = extract(named, packs, outputs=REPORTED)
    assert "extracted_data" not in few.columns and RESULT_COLUMNS[0] in few.columns
    want = sorted(map(str, P.report_rows(whole).collect()))
    assert sorted(map(str, P.report_rows(few).collect())) == want
    assert any(" | " in r for r in want)
    # packs without the field
    none = extract(named, [], outputs=("multiple_dates", "error")).select("multiple_dates").distinct().collect()
    assert [r[0] for r in none] == [None]


def test_elements_without_a_keyword_are_not_gone_through(spark):
    element = "struct<page:int,elem_idx:int,text:string,x0:double,x1:double,y0:double>"
    many = [(0, 0, "CASE\nNUMBER:", 0.0, 9.0, 9.0), (0, 1, "a", 9.0, 9.5, 9.0), (0, 2, "Case Number:", 10.0, 11.0, 9.0), (0, 3, "2020-CA", 12.0, 13.0, 9.0)]
    rows = [(1, many), (2, many[:2]), (3, [(0, 0, None, 0.0, 1.0, 1.0), None, *many[2:]]), (4, []), (5, None)]
    d = spark.createDataFrame(rows, f"id int, text string, elements array<{element}>".replace("text string, elements", "elements")).withColumn("text", F.lit(""))
    found = with_fields(d, PACK, only=["case_number"])
    assert {r["id"]: r["field_case_number"] for r in found.collect()} == {1: "2020-CA", 2: None, 3: "2020-CA", 4: None, 5: None}
    assert "Contains(_element_texts" in plan_of(found) or "Contains(lower(array_join" in plan_of(found)


def test_ends_of_sections_are_looked_up_once(spark):
    texts = ["Plaintiff A vs. B", "vs. Plaintiff A", "Plaintiff  ", "no", "", None, "Petitioner v. Plaintiffé x versus"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    found = d.select(rule_column(PACK.rules["plaintiff"], Doc(F.col("t"), F.lower("t"))).alias("v"))
    assert [r[0] for r in found.collect()] == ["A", "A", None, None, None, None, "é x"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("least(") == 1


def test_bound_values_are_plain_columns_below_the_generator(spark):
    d = N.bind(spark.range(3), {"v": F.upper(F.col("id").cast("string"))}).where("v <> '1'")
    assert d.columns == ["id", "v"] and sorted(r["v"] for r in d.collect()) == ["0", "2"]
    assert "inline(array(struct(v, _bound_v" in plan_of(d) and plan_of(d).count("upper(") <= 1


def test_contact_lowers_and_measures_once(spark):
    d = spark.createDataFrame([("a\n\x1f\x1f b\nJURY  DEMANDED now\nX",), ("É  x\nplaintiff demandss",), ("",), (None,)], "text string")
    steps = d
    for columns in N.line_steps(F.col("text"), "lines"):
        steps = steps.withColumns(columns)
    for r in steps.select("lines", N.normalized_lines(F.col("text")).alias("want")).collect():
        assert r["lines"] == r["want"]
    plan = add_contact(d, "text", "c")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") and "octet_length(concat(" in plan
    # lowered for the trigger and for the lines, besides those of the contact's own lines
    assert plan.count("lower(text") == 2


def test_dates_are_parsed_by_two_searches(spark):
    texts = ["on May 3rd, 2020 or June 4, 2021", "x 1/2/2020 and May 3, 2019", "1-12-2020", "aUGUſT 3 2020", "12-1-2020\nmay 9,\n1999", "1/2/20 May 5, 2001 3/4/2005", "none", "", None, "a $1 # 10/11/2012 #"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ["2020-05-03", "2020-01-02", "2020-01-12", "2020-01-03", "1999-05-09", "2005-03-04", None, None, None, "2012-10-11"]
    assert [r[0] for r in d.select(D.parse_date(F.col("t"))).collect()] == want
    listed = d.select(F.transform(F.array("t"), lambda t: D.from_parts(D.date_parts(t)))[0])
    assert [r[0] for r in listed.collect()] == want
    # one test and one search for each of three shapes, not one search per group
    assert str(D.parse_date(F.col("t"))).lower().count("regexp_extract") == 0
