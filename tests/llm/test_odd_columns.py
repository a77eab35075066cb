"""Columns of awkward names and types come back from every operator that keeps a table's columns; empty tables stay empty."""

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, gbt_quality, minhash, mixing, ngram_lm, pii, sharding, weak_supervision

SCHEMA = "doc_id long, text string, source string, `a.b` int, `c``d e` string, kept string, m map<string,int>"
TEXT = "one two three four five six seven"
ROWS = [(1, TEXT, "x", 1, "p", "k", {"z": 1}), (2, TEXT, "x", 2, "q", None, None), (3, None, None, None, None, None, {}), (4, "", "y", 4, "", "k", {"y": 2, "z": None})]
OPERATORS = {
    "near_duplicates": minhash.near_duplicates,
    "mix": lambda d: mixing.mix(d, F.coalesce(F.length("text"), F.lit(0))),
    "external_shuffle": sharding.external_shuffle,
    "sanitise": pii.sanitise,
    "score": lambda d: gbt_quality.score(d, gbt_quality.train(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "bpe_encode": bpe.bpe_encode,
    "bpe_decode": lambda d: bpe.bpe_decode(bpe.bpe_encode(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_come_back(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = OPERATORS[name](docs)
    assert {"a.b", "c`d e", "m"} <= set(out.columns)
    found = {r["doc_id"]: (r["a.b"], r["c`d e"], r["m"]) for r in out.collect()}
    assert found == {r[0]: (r[3], r[4], r[6]) for r in ROWS}
    assert out.count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_stay_empty(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_and_digests_of_odd_tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert ngram_lm.score(docs).count() == bpe.bpe_digests(docs).count() == weak_supervision.quality(docs).count() == len(ROWS)
    assert "a.b" in bpe.bpe_round_trip(docs).columns and bpe.bpe_round_trip(docs).filter("round_trip").count() == len(ROWS)
