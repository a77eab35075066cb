"""Training sets keyed by star: every star is accounted for."""

from pyspark.sql import functions as F

from tidewatch.operators import catalog

ROWS = [("a", 1, 5.0, 1), ("a", 0, 9.0, 2), ("b", 0, 1.0, 3), ("b", None, 2.0, 4), ("c", 0, 1.0, 5), ("d", 1, 1.0, 6), ("e", 0, 3.0, 7), ("e", 0, 3.0, 8), (None, 1, 1.0, 9)]
SCHEMA = "star string, label int, weight double, id long"


def made(spark, rows=ROWS, features=None, excluded=(("c",), ("c",), (None,))):
    features = [("a", 0.5, "x"), ("b", 0.6, "y"), ("c", 0.7, "z"), ("e", None, None)] if features is None else features
    f = spark.createDataFrame(features, "star string, value double, status string")
    return catalog.training_set(spark.createDataFrame(rows, SCHEMA), f, spark.createDataFrame(list(excluded), "star string"), "star", "label", "weight", "id")


def test_every_star_has_one_status_and_used_ones_have_features(spark):
    got = {r.star: r for r in made(spark).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "used", "b": "unlabelled", "c": "excluded", "d": "unmeasured", "e": "used"}
    assert (got["a"].star_label, got["a"].reference, got["a"].value, got["a"].n_rows) == (1, 1, 0.5, 2)
    assert got["b"].value is None and got["c"].value is None and got["e"].value is None and got["e"].reference == 7


def test_empty_tables(spark):
    assert made(spark, rows=[]).count() == 0
    assert {r.status for r in made(spark, features=[], excluded=[]).collect()} == {"unlabelled", "unmeasured"}
    assert made(spark).filter(F.col("star").isNull()).count() == 0
