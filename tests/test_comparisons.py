"""Joins by preference and by nearness, rankers side by side, forecasts, thresholds, runs that survive a bad series."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boxsearch, catalog, evaluate, fold, survey

LONG = "target_id long, time double, flux double"


def test_first_available_of_a_list(spark):
    targets = [(1, [5, 3, 3, None, 1]), (2, [9]), (3, []), (4, None), (1, [5, 3, 3, None, 1]), (None, [3]), (1, [1, 3])]
    there = [(1, 3), (1, 3), (1, 1), (2, 5), (3, 9), (None, 3)]
    out = catalog.first_available(spark.createDataFrame(targets, "k long, sectors array<int>"), spark.createDataFrame(there, "k long, sector int"), "k", "sectors", "sector").collect()
    wanted = [(1, 3, 2), (2, None, None), (3, None, None), (4, None, None), (1, 3, 2), (None, None, None), (1, 1, 1)]
    assert sorted(((r.k, r.sector, r.place) for r in out), key=str) == sorted(wanted, key=str)


def test_nearest_of_key_against_all_pairs(spark):
    rng = random.Random(4)
    left = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *[rng.randint(0, 40) / 2 for _ in range(9)]])) for i in range(300)]
    right = [(rng.choice([1, 1, 2, None]), rng.choice([None, *[rng.randint(0, 40) / 2 for _ in range(9)]]), i) for i in range(80)]
    out = catalog.nearest_of_key(spark.createDataFrame(left, "i long, k long, a double"), spark.createDataFrame(right, "k long, b double, t long"), "k", "a", "b", "t").collect()

    def best(k, a):
        near = [(abs(b - a), b, t) for key, b, t in right if key == k and None not in (key, b, a)] if a is not None else []
        return min(near)[1:] if near else (None, None)

    assert {(r.i, r.b, r.t) for r in out} == {(i, *best(k, a)) for i, k, a in left}
    assert len(out) == len(left)


def test_difference_in_errors(spark):
    rows = [(10.0, 1.0, 2.0, 13.0, 0.0), (10.0, 1.0, 2.0, 7.0, None), (10.0, 3.0, 2.0, 7.0, 4.0), (10.0, 0.0, 0.0, 7.0, None), (None, 1.0, 1.0, 7.0, None)]
    c = [F.col(x) for x in "vlupe"]
    got = [r[0] for r in spark.createDataFrame(rows, "v double, l double, u double, p double, e double").select(catalog.difference_in_errors(*c)).collect()]
    assert got == [-1.5, 3.0, 0.6, None, None]


def test_rankers_against_pairs_of_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 1), rng.randint(0, 9) / 10, rng.choice([None, float("nan"), 0.3, 0.6])) for _ in range(200)] + [(None, 1, 0.5, 0.5), ("a", None, 0.5, 0.5), ("c", 1, 0.2, 0.9)]
    out = evaluate.compare_rankers(spark.createDataFrame(rows, "g string, label int, x double, y double"), ["x", "y"], "g", {"x": 0.5}).collect()
    assert len(out) == 8
    for r in out:
        score = [(-math.inf if s is None or s != s else s, y) for g, y, *xs in rows for s in [xs["xy".index(r.ranker)]] if g is not None and y is not None and (r.g is None or g == r.g)]
        p, q = [s for s, y in score if y], [s for s, y in score if not y]
        assert (r.n, r.positives) == (len(score), len(p))
        assert r.auc == (pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in q) / len(p) / len(q)) if p and q else None)
        assert r.passing == (sum(s >= 0.5 for s, _ in score) if r.ranker == "x" else 0)


def test_forecasts_and_their_intervals(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 1, 600)
    rows = [(int(i % 40), int(rng.uniform() < x), float(x)) for i, x in enumerate(p)] + [(1, None, 0.5), (2, 1, None)]
    table = spark.createDataFrame(rows, "star long, label int, p double")
    forecasts = {"true": F.col("p"), "flat": F.when(F.col("p").isNotNull(), F.lit(0.5)), "reversed": 1 - F.col("p")}
    got = {r.forecast: r for r in evaluate.forecast_scores(table, forecasts, 10, "star").collect()}
    y = np.array([r[1] for r in rows[:600]])
    assert got["true"].brier == pytest.approx(((p - y) ** 2).mean()) and got["flat"].brier == pytest.approx(0.25) and got["true"].n == 600
    assert got["true"].ece < 0.08 < got["reversed"].ece and got["true"].expected == pytest.approx(p.sum()) and got["true"].observed == y.sum()
    ends = {r.forecast: (r.low, r.high) for r in evaluate.brier_intervals(table, forecasts, "star", 60).collect()}
    assert ends["true"][0] < got["true"].brier < ends["true"][1] < ends["reversed"][0] and ends["flat"] == pytest.approx((0.25, 0.25))


def test_probability_threshold(spark):
    raw = [-2.0, -1.0, 0.0, 1.0, 2.0, 3.0]
    rows = spark.createDataFrame([(x, int(i in (2, 4, 5))) for i, x in enumerate(raw)] + [(float("nan"), 1)], "raw double, label int")
    r = evaluate.probability_threshold(rows, 2.0, -1.0, 0.5).first()
    assert (r.threshold, r.kept, r.precision, r.recall) == pytest.approx((1 / (1 + math.exp(-0.5)), 3, 2 / 3, 0.5))
    with pytest.raises(ValueError):
        evaluate.probability_threshold(rows, 1.0, 0.0, 1.0)


def test_time_averaging_against_every_bin(spark):
    rng = np.random.default_rng(5)
    t = np.concatenate([np.arange(0, 60, 0.1), np.arange(63, 120, 0.1)])
    red = np.cumsum(rng.normal(0, 1, len(t)))
    f = rng.normal(0, 1, len(t)) + (red - red.mean()) / red.std()
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, f)] + [(2, float(a), float(b)) for a, b in zip(t, rng.normal(0, 1, len(t)))] + [(3, 1.0, 1.0)], LONG)
    got = {r.target_id: r for r in fold.time_averaging(rows, 0.5, 3, 1.0).collect()}
    ratios = []
    for level in range(4):
        width, bins = 0.5 * 2**level, {}
        for a, b in zip(t, f):
            s = int(a > 61)
            bins.setdefault((s, math.floor((a - (63 if s else 0)) / width)), []).append(b)
        full = [x for x in bins.values() if len(x) >= 0.75 * width / np.median(np.diff(t))]
        ratios.append(np.std([np.mean(x) for x in full]) / (np.std(f) / math.sqrt(np.mean([len(x) for x in full])) * math.sqrt(len(full) / (len(full) - 1))))
    assert got[1].beta == pytest.approx(np.median(ratios), rel=1e-9) and got[1].n_widths == 4 and got[1].beta > 1.5
    assert got[2].beta < 1.3 and (got[3].beta, got[3].n_widths) == (1.0, 0)


def test_a_series_that_raises_does_not_end_the_run(spark):
    t = np.arange(0, 30, 0.1)
    dip = lambda k: [(k, float(a), float(1 - 0.05 * ((a % 5) < 0.5) + 1e-3 * math.sin(a * 77))) for a in t]
    poisoned = [(2, float(a) if i else 1e300, b) for i, (_, a, b) in enumerate(dip(2))]  # a grid over such a time fits no memory
    rows = spark.createDataFrame(dip(1) + poisoned + dip(3) + [(4, 1.0, 1.0)] + [(5, float(a), 1.0) for a in t], LONG)
    found = lambda errors: lambda s: boxsearch.signals(s, None, [0.3, 0.5], errors=errors).drop("round")
    got = {r.target_id: r for r in survey.with_status(found(True), 20)(rows).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "error", 3: "ok", 4: "short", 5: "nothing"}
    assert got[2].error and got[2].period is None and got[1].error is None and min(abs(got[1].period / (5.0 * a) - 1) for a in (0.5, 1, 2)) < 0.02
    assert {r.status: r.n for r in survey.summary(survey.with_status(found(True), 20)(rows), "depth").collect()} == {"ok": 2, "error": 1, "short": 1, "nothing": 1, None: 5}
    with pytest.raises(Exception):
        survey.with_status(found(False), 20)(rows).collect()


def test_resampled_precision_against_every_row(spark, monkeypatch):
    """Heavy ties, scores that are no numbers, slices shorter than a tie, and weights drawn one by one."""
    import hashlib
    import random

    monkeypatch.setattr(evaluate, "SLICE", 16)
    rng = random.Random(8)
    rows = [(f"u{i}", rng.randrange(2), 0.5 if i % 3 == 0 else rng.choice([None, float("nan"), round(rng.random(), 1), rng.random(), rng.random()]), rng.random()) for i in range(700)]
    found = evaluate.resampled_precision(spark.createDataFrame(rows, "id string, label int, a double, b double"), ["a", "b"], 5, "id").collect()
    assert len(found) == 10
    for r in found:
        drawn = {}
        for unit, label, a, b in rows:
            u = int(hashlib.md5(f"0:{r.resample}:{unit}".encode()).hexdigest()[:8], 16) / 2**32
            s = a if r.ranker == "a" else b
            s = float("-inf") if s is None or s != s else s
            weight = sum(u >= c for c in evaluate._POISSON)
            p, n = drawn.get(s, (0, 0))
            drawn[s] = p + label * weight, n + weight
        tp = k = total = 0
        for s in sorted(drawn, reverse=True):
            tp, k = tp + drawn[s][0], k + drawn[s][1]
            total += drawn[s][0] * tp / k if k else 0
        assert r.positives == tp and abs(r.ap - total / tp) < 1e-12
    nothing = spark.createDataFrame([], "id string, label int, a double, b double")
    assert evaluate.resampled_precision(nothing, ["a", "b"], 5, "id").count() == 0
    assert evaluate.win_rate(nothing.withColumnRenamed("a", "score"), "b", 5, "id").first().n == 0
