"""Stages of the pipeline on odd rows: nulls, empty texts, repeats, ties, extra columns of clashing names, an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm._common import written

SF = "/root/testdata/sf0.001"
EXTRA = {"kept": "long", "copies": "string", "quality_score": "double", "sanitised": "long", "component_id": "string", "a.dot": "int", "copy": "long", "size": "string"}


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    kinds = dict(docs.dtypes)
    text = "the river ran past the old mill and on to the quiet sea where boats were waiting for the tide to turn again " * 6
    rows = [(None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", None, "web", 0), (9003, "  \n\t ", "en", "web", 5), (9004, text, "en", "web", None), (9004, text, "en", "web", None)]
    rows += [(None, text, "en", "web", 1), (9005, text, "fr", None, 2), (9006, text + "x" * 300_000, "en", "web", 3)]
    return docs, spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in docs.columns))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd, name):
    docs = odd[0].unionByName(odd[1]).select("*", *[F.lit(7).cast(kind).alias(c) for c, kind in EXTRA.items()])
    stage = dict(corpus_pipeline.STAGES)[name]
    out = written(stage(spark, docs, SF), "odd")
    if name == "tokens":
        assert out.count() == docs.count()
    else:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all(r[c] == {"string": "7"}.get(kind, 7) for r in out.collect() for c, kind in EXTRA.items())
        again = stage(spark, docs.drop(*EXTRA), SF)
        assert name == "mix" or sorted(map(str, again.collect())) == sorted(map(str, out.drop(*EXTRA).collect()))
    ids = {r.doc_id for r in out.collect()}
    if name == "near_duplicates":
        assert {9001, 9002, 9003, 9004} <= ids and not {9005, 9006} & ids  # a long last word is but one of many shingles
        assert out.filter("doc_id = 9004").count() == 2  # rows that repeat an id agree
    if name == "personal_data":
        assert out.count() == docs.count() and out.filter("doc_id = 9001").first().text is None and out.filter("doc_id = 9002").first().text == ""
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0
