"""Packs, sinks, mapping and streams."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import catalog as C
from docketry.registry.queries import QUERIES, RESULT_FIELDS, nested_cases
from docketry.session import shared_folder
from docketry.sources import packs as PK
from docketry.sources import sinks as SK
from docketry.sources import tables as TB
from docketry.streaming import jobs as ST


def test_pack_order_and_choice():
    pack = PK.shipped_pack()
    assert len(pack.fields) == 22 and pack.fields[0] == "case_number"
    assert PK.pack_for_county("orangecounty").fields == pack.fields
    assert PK.pack_for_county("nowhere") is None
    assert PK.individual_pack().fields == pack.fields


def test_bad_packs_are_refused():
    for rule in (
        {"type": "regex", "regex": "("},
        {"type": "multi_date", "date_patterns": [r"\d*"]},
        {"type": "multi_pattern", "patterns": [{"regex": r"\b"}]},
        {"type": "regex", "regex": r"(a)?(?(1)b|c)"},
        {"type": "multi_date", "date_patterns": [r"\N{DIGIT ONE}"]},
    ):
        with pytest.raises(ValueError):
            PK.parse_pack(json.dumps({"patterns": {"x": rule}}))


def test_equal_packs_share_a_pass():
    pack = PK.shipped_pack()
    merged = PK.merge_equal([pack.for_counties(["a"]), pack.for_counties(["b"])])
    assert [p.counties for p in merged] == [("a", "b")]


def test_sinks_can_run_twice(spark):
    rows = spark.createDataFrame([("a.b.pdf", "x"), ("c.pdf", None)], "pdf_file string, county string")
    path = shared_folder(spark, "sink")
    for _ in range(2):
        SK.write_per_document_json(rows, path)
        SK.write_batch_json(rows, path + "-batch", "r1")
    back = spark.read.json(path)
    assert sorted((r["stem"], r["county"]) for r in back.collect()) == [("a.b", "x"), ("c", "unknown")]
    assert spark.read.json(path + "-batch").count() == 2


def test_batch_json_is_packed(spark):
    rows = spark.createDataFrame([("a.pdf", "x" * 9), ("b.pdf", None)], "pdf_file string, text string")
    path = shared_folder(spark, "packed")
    SK.write_batch_json(rows, path, "r1")
    files = [r[0] for r in spark.read.json(path).select(F.input_file_name()).distinct().collect()]
    assert files and all(f.endswith(".json.gz") for f in files)
    back = spark.read.schema("pdf_file string, text string, run_id string").json(path)
    assert sorted(tuple(r) for r in back.collect()) == [("a.pdf", "x" * 9, "r1"), ("b.pdf", None, "r1")]


def test_listing_and_missing_mapping(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    listed = TB.list_filings(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[-1] for r in listed] == ["a.pdf"]
    assert TB.read_mapping(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "m.json").write_text('{"a.pdf": {"doc_id": "1", "original_path": "p", "local_path": "l"}}')
    assert TB.read_mapping(spark, str(tmp_path / "m.json")).first()["doc_id"] == "1"


def test_first_of_two_equal_paths_is_updated(spark):
    flat = spark.createDataFrame(
        [("c", "Court", i, "p", "d", None) for i in range(2)],
        "case_id string, court_name string, idx int, doc_path string, description string, incident_date string")
    results = spark.createDataFrame(
        [("c", "p", "new", None, None, None, 1), ("c", "p", "newer", None, None, None, 2),
         ("c", "q", "x", None, None, None, 1)],
        "case_id string, doc_path string, incident_date string, incident_end_date string,"
        "emails string, plaintiff_contact string, n int")
    cases, status = C.update_batch(nested_cases(flat), results, "n")
    assert [d["incident_date"] for d in cases.first()["documents"]] == ["newer", None]
    assert {(r["doc_path"], r["status"]) for r in status.collect()} == {("p", "updated"), ("q", "not_found")}


def test_stream_equals_batch(spark, sf):
    stream = QUERIES["t1_stream_extraction"](spark, sf)
    batch = QUERIES["d9_range"](spark, sf)
    same = stream.join(batch, "filing_id").where("filing_id % 8 NOT IN (5, 6)")
    assert stream.columns == list(RESULT_FIELDS)
    assert same.where(~stream["incident_date"].eqNullSafe(batch["incident_date"])).count() == 0


def test_retried_micro_batch_writes_once(spark):
    path = shared_folder(spark, "log")
    write = ST._to_batch_partition(path)
    batch = spark.createDataFrame([("j", "done", 1)], "job_id string, status string, ts int")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(path).count() == 1


def test_suffix_lookup_survives_a_hot_name(spark):
    files = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot_x.pdf")).otherwise(
            F.concat(F.col("id").cast("string"), F.lit("_y.pdf"))).alias("pdf_file"))
    mapping = spark.createDataFrame(
        [("x.pdf", "1", "p1", 2), ("_x.pdf", "2", "p2", 1), ("y.pdf", "3", "p3", 0)],
        "file_name string, doc_id string, original_path string, seq int")
    rows = C.map_files(files, mapping, "seq").groupBy("mongo_doc_id").count().collect()
    assert {r["mongo_doc_id"]: r["count"] for r in rows} == {"2": 1000, "3": 2000}
