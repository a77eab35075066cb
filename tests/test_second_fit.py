"""Second fits around a signal, and learning curves over random subsets of stars."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boxsearch, detrend, ranking
from tidewatch.plans import search_queries

PERIODS, DURATIONS = np.geomspace(1.5, 6.0, 400).tolist(), [0.1, 0.2, 0.3]
LONG = "target_id string, sample_id long, time double, flux double"


def wave(time, seed):
    return 1 + 0.004 * np.sin(2 * np.pi * time / 9) + 2e-4 * np.random.default_rng(seed).standard_normal(len(time))


def table_of(spark, **curves):
    return spark.createDataFrame([(k, i, float(t), float(x)) for k, (time, flux) in curves.items() for i, (t, x) in enumerate(zip(time, flux))], LONG)


def flat(spark, series, **kw):
    out = {}
    for r in detrend.flattened_around_signal(series, PERIODS, DURATIONS, spacing=1.5, **kw).orderBy("target_id", "time").collect():
        out.setdefault(r.target_id, []).append(r)
    return out


def test_a_dip_beside_a_gap_keeps_its_depth(spark):
    """Dips of 0.3 day every 3 days; one ends in a gap, where the blind fit follows it and the second runs across."""
    time = np.array([t for t in np.arange(0, 27, 0.02) if not 7.12 < t < 8.3])
    inside = np.abs((time - 1 + 1.5) % 3 - 1.5) < 0.15
    dips = wave(time, 0) * (1 - 0.006 * inside)
    series = table_of(spark, dips=(time, dips), short=(time[:20], wave(time[:20], 2)), bad=(np.append(time, np.nan), np.append(wave(time, 3), 1.0)))
    got = flat(spark, series)
    assert set(got) == {"dips", "bad"} and len(got["bad"]) == len(time)
    rows, found = got["dips"], np.array([r.flux for r in got["dips"]])
    mask = np.array([r.masked for r in rows])
    assert rows[0].signal_period == pytest.approx(3.0, rel=0.01) and mask[inside].all() and mask.mean() < 0.25
    blind = detrend.flattened(series.filter("target_id = 'dips'"), spacing=1.5).orderBy("time").toPandas()["flux"].to_numpy()
    cut = inside & (np.abs(time - 7) < 0.2)
    assert (1 - found[cut]).mean() == pytest.approx(0.006, abs=6e-4) and (1 - blind[cut]).mean() < 0.002
    again = detrend.flat_of(time, dips / np.median(dips), ~mask, 1.5, 0.5, 4.0, support=0.05)
    assert np.allclose(again[0], found, atol=1e-12) and np.array_equal(again[2], [r.clipped for r in rows])


def test_columns_without_support_get_their_samples_back():
    """Nothing is free in the last two knot intervals: the trend would run off, and does without a least support."""
    time = np.arange(0, 10, 0.02)
    flux, free = wave(time, 5) + 0.01 * time, time < 7
    error = [np.abs(detrend.trend_of(time, flux, free, 1.0, 0.5, support) - flux).max() for support in (0.0, 0.05)]
    assert error[1] < 0.002 < error[0]


def test_the_blind_fit_stays_where_nothing_is_masked(spark):
    time = np.arange(0, 27, 0.02)
    dips = wave(time, 0) * (1 - 0.006 * (np.abs((time - 1 + 1.5) % 3 - 1.5) < 0.15))
    series = table_of(spark, a=(time, dips), bumps=(time, 2 - dips))
    blind = {(r.target_id, r.sample_id): r.flux for r in detrend.flattened(series, spacing=1.5).collect()}
    for kw in ({"threshold": 1e9}, {"share": 0.01}):
        rows = [r for part in flat(spark, series, **kw).values() for r in part]
        assert len(rows) == len(blind) and not any(r.masked for r in rows) and all(r.signal_period is None or r.signal_period != r.signal_period for r in rows)
        assert all(r.flux == pytest.approx(blind[r.target_id, r.sample_id], abs=1e-12) for r in rows)
    assert detrend.flattened_around_signal(series.limit(0), PERIODS, DURATIONS).count() == 0


def test_fit_and_search_take_one_exchange(spark):
    series = table_of(spark, a=(np.arange(0, 9, 0.1), np.ones(90)))
    plan = detrend.flattened_around_signal(series, PERIODS, DURATIONS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_the_strongest_box_is_the_first_signal(spark):
    time = np.arange(0, 20, 0.05)
    flux = wave(time, 4) - 0.004 * np.sin(2 * np.pi * time / 9) - 0.01 * (np.abs((time - 1 + 1.2) % 2.4 - 1.2) < 0.1)
    s = boxsearch.signals(table_of(spark, a=(time, flux)), PERIODS, DURATIONS).first()
    best, away = boxsearch.strongest(time, flux, np.full(len(time), 1 / flux.var()), np.array(PERIODS), DURATIONS)
    assert {k: s[k] for k in best} == pytest.approx(best) and len(away) == len(time) and (away <= s.period / 2 + 1e-9).all()
    assert boxsearch.strongest(time, np.ones(len(time)), np.full(len(time), np.nan), np.array(PERIODS), DURATIONS) is None


@pytest.mark.parametrize("n,sizes", [(1, [1]), (20, [20]), (21, [20, 21]), (170, [20, 40, 80, 160, 170])])
def test_sizes_double_and_end_with_all(n, sizes):
    got = ranking.subset_sizes(n, 20, 3)
    assert sorted({s for s, _ in got}) == sizes and [d for s, d in got if s == n] == [0] and all(len([0 for x, _ in got if x == s]) == 3 for s in sizes[:-1])


def _stars(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"{seed}-{i}", int(i % 3 == 0), float(rng.normal(2.0 * (i % 3 == 0))), float(rng.normal())) for i in range(n) for _ in range(2)]
    return spark.createDataFrame(rows, "target_id string, label int, a double, b double")


def test_subsets_hold_whole_stars_and_lie_in_larger_ones(spark):
    rows = _stars(spark, 400, 0).unionByName(spark.createDataFrame([(None, 1, 0.0, 0.0), ("z", None, 0.0, 0.0)], "target_id string, label int, a double, b double"))
    got = {(r["size"], r.draw): r for r in ranking.subset_counts(rows, 50, 4).collect()}
    assert set(got) == {(s, d) for s in (50, 100, 200) for d in range(4)} | {(400, 0)}
    assert all(r.n == 2 * r.n_stars and abs(r.n_stars - s) < 4 * s**0.5 for (s, _), r in got.items()) and got[400, 0].n_stars == 400 and got[400, 0].positives == 268
    small, large = ({r.target_id for r in rows.filter("label IS NOT NULL AND target_id IS NOT NULL").filter(ranking._drawn("target_id", F.lit(1), F.lit(x), 0)).collect()} for x in (0.125, 0.25))
    assert small < large and len(small) == got[50, 1].n_stars
    assert ranking.subset_counts(rows.limit(0), 50, 4).count() == 0


def test_learning_curve_rises_and_leaves_known_stars_out(spark):
    rows, test = _stars(spark, 160, 1).cache(), _stars(spark, 150, 2).cache()
    seen = rows.withColumn("label", 1 - F.col("label"))  # would spoil the ranking if it were scored
    got = {r["size"]: r for r in ranking.learning_curve(rows, test.unionByName(seen), ["a", "b"], start=40, repeats=2, trees=3).collect()}
    assert set(got) == {40, 80, 160} and [got[s].n_draws for s in (40, 80, 160)] == [2, 2, 1]
    assert got[160].sd is None and got[40].sd is not None and got[160].mean_stars == 160
    assert got[160].average_precision > 0.7 and all(1 / 3 < r.average_precision <= 1 for r in got.values())
    with pytest.raises(ValueError):
        ranking.learning_curve(rows.filter("label = 1"), test, ["a", "b"])


def test_learning_curve_scores_held_out_rows_in_one_pass_and_small_subsets_take_one_task(spark):
    rows, test = _stars(spark, 160, 1).repartition(8).cache(), _stars(spark, 150, 2).cache()
    plan = ranking.learning_curve(rows, test, ["a", "b"], start=40, repeats=2, trees=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Generate inline" in plan
    assert ranking.in_few_tasks(rows, 320).rdd.getNumPartitions() == 1 and ranking.in_few_tasks(rows, 3 * ranking.WORTH).rdd.getNumPartitions() == 3
    assert ranking.in_few_tasks(rows, 10**9).rdd.getNumPartitions() == 8


def test_the_learning_curve_query_does_all_draws_and_trees_on_signals_of_the_whole_grid(spark, monkeypatch):
    asked = {}

    def noted(*args, **given):
        asked.update(inspect.signature(real).bind(*args, **given).arguments)
        return args[0].unionByName(args[1])

    real = ranking.learning_curve
    monkeypatch.setattr(ranking, "learning_curve", noted)
    periods = {r.period for r in search_queries.learning_curve(spark, "/root/testdata/sf0.001").collect()}
    defaults = {k: p.default for k, p in inspect.signature(real).parameters.items()}
    assert all(asked.get(k, defaults[k]) >= defaults[k] for k in ("repeats", "trees", "depth"))
    assert len(periods - set(search_queries.PERIODS)) > 5 and any(p < min(search_queries.PERIODS) for p in periods)
