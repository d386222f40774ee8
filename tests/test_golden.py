"""The eight filing variants, error rows and options of the date resolution."""

import pytest
from pyspark.sql import functions as F

from docketry import fixtures as X
from docketry.plans.extract import MISSING_TEXT, extract
from docketry.registry.queries import ALL_COUNTIES, PACK, results_of

# variant: primary date, source field, end date, number of candidates
GOLDEN = {
    0: ("October 3, 1998 (collision)", "multiple_dates_extractor", None, 4),
    1: ("May 28, 1997 (incident, occurred)", "multiple_dates_extractor", None, 6),
    2: ("02/25/1999", "advanced_incident_date", None, 2),
    3: ("Date of accident: 7/25/1997", "date_of_incident", None, 5),
    4: ("On November 10, 2000", "incident_date_simple", "November 15, 2000 (death)", 4),
    5: ("September", "fuzzy_incident_date", None, 0),
    6: (None, None, None, 0),
    7: (
        "subject incident happened at approximately 10:30 a.m. on July 21th, 2000",
        "subject_incident_date", None, 7,
    ),
}


@pytest.fixture(scope="module")
def first_of_each(spark):
    filings = X.filings(spark, "/root/testdata/sf0.01").where("filing_id < 8")
    rows = results_of(filings, ALL_COUNTIES).collect()
    return {r["variant"]: r for r in rows}


@pytest.mark.parametrize("variant", GOLDEN)
def test_variant(first_of_each, variant):
    row = first_of_each[variant]
    found = (
        row["incident_date"], row["incident_source_field"], row["incident_end_date"],
        len(row["all_incident_dates"]),
    )
    assert found == GOLDEN[variant]


def test_contact_block(first_of_each):
    for variant, row in first_of_each.items():
        if variant in (2, 5):
            assert row["plaintiff_contact"] is None
        else:
            first, second = row["plaintiff_contact"].split("\n")
            assert first.startswith("Law Office of ") and second.endswith("@example.com")


TROUBLE = (
    "Paid on the ledger 1/1/2024 in full. Nothing else of note was written down by the clerk here. "
    "On or about September 3,2025 it began."
)


def one(spark, text, **options):
    df = spark.createDataFrame([("a.pdf", "x", text)], "pdf_file string, county string, text string")
    return extract(df, [PACK.for_counties(["x"])], **options).collect()[0]


def test_uncomparable_dates_give_an_error_row(spark):
    row = one(spark, TROUBLE)
    assert "NoneType" in row["error"]
    assert row["incident_date"] is None and row["extracted_data"] is None


def test_null_safe_takes_the_earliest_date(spark):
    row = one(spark, TROUBLE, null_safe=True)
    assert row["error"] is None and row["incident_date"] == "1/1/2024"


def test_missing_text_is_an_error_row(spark):
    assert one(spark, None)["error"] == MISSING_TEXT


def test_county_without_pack_has_no_fields(spark):
    df = spark.createDataFrame(
        [("a.pdf", "y", "On May 1, 2020 a@b.org")], "pdf_file string, county string, text string")
    row = extract(df, [PACK.for_counties(["x"])]).collect()[0]
    assert row["extracted_data"] == {} and row["emails"] == "a@b.org"


def test_two_rule_sets_cover_all_rows_once(spark):
    other = PACK.for_counties(["y"])
    other = type(other)(("y",), {"numeric_date": PACK.rules["numeric_date"]}, ("numeric_date",))
    df = spark.createDataFrame(
        [(i, c, "On May 1, 2020 and 3/4/2021") for i, c in enumerate(["x", "y", "z", None])],
        "id int, county string, text string")
    rows = extract(df, [PACK.for_counties(["x"]), other]).orderBy("id").collect()
    assert [sorted(r["extracted_data"])[-1:] for r in rows] == [
        ["numeric_date"], ["numeric_date"], [], []]
    assert len(rows[0]["extracted_data"]) > 1 and len(rows[1]["extracted_data"]) == 1
    assert [r["county"] for r in rows] == ["x", "y", "z", "unknown"]


def test_extraction_has_no_shuffle(spark):
    df = spark.createDataFrame([("x", "t")], "county string, text string")
    plan = extract(df, [PACK.for_counties(["x"])])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_filter_on_results_stays_above(spark):
    df = spark.createDataFrame([("x", TROUBLE), ("x", "fine")], "county string, text string")
    assert extract(df, [PACK.for_counties(["x"])]).where(F.col("error").isNull()).count() == 1
