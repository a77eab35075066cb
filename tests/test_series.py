"""Semantics at the edges: gaps, folds, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import catalog as C
from tidewatch.operators import evaluate as V
from tidewatch.operators import boxsearch, fold
from tidewatch.operators import series as S

LONG = "target_id long, sample_id long, time double, flux double"


def test_a_gap_as_long_as_the_threshold_does_not_break(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 1.0), (1, 2, 2.5, 1.0)], LONG)
    assert [r.segment for r in S.segments(rows, 1.0).orderBy("time").collect()] == [0, 0, 1]


def test_finite_and_zero_median(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, float("nan")), (1, 1, 1.0, 2.0), (1, 2, 2.0, None), (2, 3, 0.0, 0.0)], LONG)
    assert [r.flux for r in S.normalised(S.finite(rows)).collect()] == [1.0]


def test_phase_and_event_of_negative_times(spark):
    rows = spark.createDataFrame([(1, 0, -2.0, 1.0), (1, 1, 2.0, 1.0)], LONG)
    got = fold.folded(rows, 4.0, 0.0, 1.0).orderBy("time").collect()
    assert [(r.phase, r.event) for r in got] == [(-2.0, 0), (-2.0, 0)]  # half rounds to even


def test_constant_series_have_no_scatter_and_empty_tables_no_rows(spark):
    rows = spark.createDataFrame([(1, i, float(i), 3.0) for i in range(5)], LONG)
    assert S.robust_sigma(rows).first().sigma == 0.0
    empty = rows.filter("false")
    assert fold.event_depths(empty, 3.0, 0.0, 1.0).count() == 0
    assert S.densest_window(empty, 2.0).count() == 0


def test_a_box_is_found_at_its_period(spark):
    rows = [(1, i, i * 0.05, 0.9 if (i * 0.05) % 3.0 < 0.5 else 1.0 + 0.001 * (i % 3)) for i in range(600)]
    found = boxsearch.box_search(spark.createDataFrame(rows, LONG), [2.5, 3.0, 4.1], [0.5])
    assert found.orderBy(F.desc("power")).first().period == 3.0


def test_tied_scores_are_one_threshold(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "label int, score double")
    assert V.average_precision(tied).first().ap == pytest.approx(0.5)
    assert V.roc_auc(tied).first().auc == pytest.approx(0.5)
    assert V.roc_auc(tied.filter("label = 1")).first().auc is None


def test_sectors_and_repeated_keys(spark):
    one = spark.range(1).select(C.parse_sectors(F.lit("14-16,20; x ,15")).alias("s"))
    assert one.first().s == [14, 15, 16, 20]
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    with pytest.raises(Exception, match="repeats"):
        C.unique_left_join(spark.createDataFrame([(1,)], "id int"), twice, ["id"]).collect()


def test_robust_rms_drops_what_is_far(spark):
    rows = [(1, x) for x in (1.0, 1.1, 0.9, 1.05, 0.95, 50.0, None)] + [(2, 3.0), (2, 3.0)] + [(3, None), (4, 0.0)]
    got = {r.target_id: (r.n, r.kept, round(r.rms, 9)) for r in S.robust_rms(spark.createDataFrame(rows, "target_id long, flux double")).collect()}
    near = (1.0, 1.1, 0.9, 1.05, 0.95)
    assert got == {1: (7, 5, round((sum(x * x for x in near) / 5) ** 0.5, 9)), 2: (2, 2, 3.0), 3: (1, 0, 1.0), 4: (1, 1, 1.0)}


def test_scatter_of_few_and_unknown_samples(spark):
    rows = [(1, 2.0), (1, None), (2, None), (3, 1.0), (3, 2.0), (3, 4.0), (3, 9.0)]
    got = {r.target_id: tuple(r)[1:] for r in S.robust_scatter(spark.createDataFrame(rows, "target_id long, flux double")).collect()}
    assert got == {1: (2, 2.0, 0.0, 2.0, 2.0), 2: (1, None, None, None, None), 3: (4, 3.0, 1.5 * S.MAD, 1.0, 9.0)}
