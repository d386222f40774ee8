"""Each stage of the pipeline on odd rows, with columns named as the operators name theirs, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASHING = ("key", "more", "x", "score", "base", "spans", "component_id", "class", "ids", "item_id", "predicted", "label", "row", "block", "n_links")


@pytest.fixture(scope="module")
def strange(spark, odd, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    d = odd.select("doc_id", "text").union(real.select(F.col("doc_id") + 1000, "text"))
    return d.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, sf, strange, name, stage):
    out = stage(spark, strange, sf)
    rows, before = out.collect(), {(r.doc_id, r.text): r for r in strange.collect()}
    if name == "byte-level BPE":
        assert len(rows) == strange.count() and {len(r.ids) for r in rows if r.doc_id in (1, 2)} == {0}
    else:
        assert out.columns == strange.columns and 0 < len(rows) <= strange.count()
        for r in rows:
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in CLASHING)
            assert name == "PII" or (r.doc_id, r.text) in before
    if name == "PII":
        assert len(rows) == strange.count()
        assert [(r.doc_id, r.n_chars, r.text) for r in rows if r.n_chars != (None if r.text is None else len(r.text))] == []
    assert stage(spark, strange.limit(0), sf).count() == 0
