"""Detrending, features, single dips, stores, files and ranking, against brute force and planted signals."""

import math
import statistics
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import boxsearch, detrend, evaluate, features, fold, ranking, single, store, views
from tidewatch.operators import series as S
from tidewatch.sources import files

LONG = "target_id long, sample_id long, time double, flux double"
PERIODS, DURATIONS = [3.0, 4.0, 5.0, 6.5], [0.5, 1.0]


def dips(target, n=400, period=5.0, epoch=1.0, depth=0.02, length=1.0, seed=0, noise=0.002):
    g = np.random.default_rng(seed)
    t = np.arange(n) * 0.1
    x = (t - epoch + period / 2) % period - period / 2
    f = 1 - depth * (np.abs(x) < length / 2) + g.normal(0, noise, n)
    return [(target, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, f))]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame(dips(1) + dips(2, period=4.0, depth=0.03, seed=1), LONG)


def mad(v):
    m = statistics.median(v)
    return 1.4826 * statistics.median([abs(x - m) for x in v])


def brute_features(t, f, r, sde, contrast, clipped):
    """All 23 features of one series, sample by sample."""
    s, n, p, d, y = mad(f), len(f), r.period, r.duration, np.asarray(f) - 1
    t, f = np.asarray(t), np.asarray(f)

    def fold(period, epoch):
        return (t - epoch + period / 2) % period - period / 2

    def box(inside, among):
        a, b = f[among & ~inside], f[among & inside]
        return a.mean() - b.mean(), s * math.sqrt(1 / len(a) + 1 / len(b))

    def red(keep):
        tt, ff = t[keep], f[keep]
        width = max(d, 3 * np.median(np.diff(t)))
        groups = {}
        for a, b in zip(tt, ff):
            groups.setdefault(math.floor((a - tt[0]) / width), []).append(b)
        full = [v for v in groups.values() if len(v) >= 2]
        if len(full) < 4:
            return None
        return statistics.pstdev(map(statistics.mean, full)) / (mad(list(ff)) / math.sqrt(statistics.mean(map(len, full))))

    x, h = fold(p, r.epoch), fold(p, r.epoch + p / 2)
    inside, late = np.abs(x) < d / 2, np.abs(h) < d / 2
    base = f[~inside & ~late].mean()
    all_ = np.ones(n, bool)

    def events(mask, epoch):
        k = np.rint((t - epoch) / p)
        return {e: (base - f[mask & (k == e)].mean(), (mask & (k == e)).sum() / s**2) for e in np.unique(k[mask])}

    def birge(groups):
        chi2, dof = 0.0, 0
        for g in groups:
            if g:
                mean = sum(a * w for a, w in g) / sum(w for _, w in g)
                chi2, dof = chi2 + sum(w * (a - mean) ** 2 for a, w in g), dof + len(g) - 1
        return math.sqrt(chi2 / dof) if dof >= 2 else 1.0

    ev, ev2 = events(inside, r.epoch), events(late, r.epoch + p / 2)
    odd, even = [v for e, v in ev.items() if e % 2 == 1], [v for e, v in ev.items() if e % 2 == 0]
    gain = {e: sum(((a - 1) ** 2 - (a - 1 + r.depth) ** 2) / (2 * s * s) for a in f[inside & (np.rint((t - r.epoch) / p) == e)]) for e in ev}
    pair = [(sum(a * w for a, w in g) / sum(w for _, w in g), sum(w for _, w in g)) for g in (odd, even)]
    main, second, half = box(inside, all_), box(late, ~inside), box(np.abs(fold(p / 2, r.epoch)) < d / 2, all_)
    wide = max(1.0, red((np.abs(x) >= d) & (np.abs(h) >= d)) or 1.0)
    angle = 2 * math.pi * x / p
    amplitude = math.hypot(2 * (y * np.cos(angle)).mean(), 2 * (y * np.sin(angle)).mean())
    near = np.abs(x) < 1.5 * d

    def left(q):
        shape = np.clip((d / 2 - np.abs(x[near])) / max(d / 2 * (1 - q), 1e-6), 0, 1)
        return ((y[near] - shape * (shape * y[near]).sum() / (shape**2).sum()) ** 2).sum()

    central = 10 ** (math.log10(d) - r.log_duration_ratio)  # its own test is that of the physics
    z = f - f.mean()
    return {
        "bls_sde": sde, "bls_depth_snr": main[0] / main[1], "bls_depth_over_scatter": r.depth / s, "delta_loglike": sum(gain.values()), "power_contrast": contrast, "log_depth": math.log10(r.depth),
        "bls_duration": d, "duration_over_period": d / p, "log_duration_ratio": math.log10(d / central), "log_period": math.log10(p), "n_transits": len(ev), "min_points_per_transit": min((inside & (np.rint((t - r.epoch) / p) == e)).sum() for e in ev),
        "odd_even_sigma": abs(pair[0][0] - pair[1][0]) / math.sqrt(1 / pair[0][1] + 1 / pair[1][1]) / max(wide, birge([odd, even])),
        "secondary_sigma": second[0] / second[1] / max(wide, birge([list(ev2.values())])), "half_period_depth_ratio": half[0] / r.depth,
        "flat_bottom_fraction": min((round(left(round(0.95 * i / 19, 4)), 12), round(0.95 * i / 19, 4)) for i in range(20))[1], "harmonic_delta_loglike": n * amplitude**2 / 4 / s**2, "harmonic_amp_over_depth": amplitude / r.depth,
        "red_noise_beta": red(~inside), "log_scatter": math.log10(s), "max_single_event_fraction": max(map(abs, gain.values())) / sum(map(abs, gain.values())), "flux_skew": (z**3).mean() / (z**2).mean() ** 1.5, "clipped_fraction": clipped,
    }


def test_all_features_against_brute_force(spark, two):
    signals = boxsearch.signals(two, None, DURATIONS)
    marked = two.withColumn("clipped", (F.col("target_id") == 1) & (F.col("sample_id") % 50 == 7))
    by = {r.target_id: r for r in signals.collect()}
    got = {r.target_id: r for r in features.extract(marked, signals).collect()}
    assert {k: round(r.period, 1) for k, r in got.items()} == {1: 5.0, 2: 4.0}
    for k, r in got.items():
        rows = sorted((x.time, x.flux) for x in marked.filter("NOT clipped").collect() if x.target_id == k)
        wanted = brute_features(*zip(*rows), r, by[k].sde, by[k].contrast, 8 / 400 if k == 1 else 0.0)
        assert list(wanted) == features.FEATURES
        for name, value in wanted.items():
            assert r[name] == pytest.approx(value, rel=1e-6, abs=1e-9), name


def test_alternating_depths_do_not_excuse_themselves(spark):
    rows = [(k, i, t, f - 0.02 * (f < 0.99) * (round((t - 1) / 5) % 2)) for k, i, t, f in dips(1, n=600)]
    one = spark.createDataFrame(rows, LONG)
    got = features.extract(one, boxsearch.signals(one, [3.0, 5.0, 7.0], DURATIONS)).first()
    assert got.period == 5.0 and got.odd_even_sigma > 10


def test_search_off_the_grid_against_every_box(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 30, 150))
    f = 1 + rng.normal(0, 0.01, 150)
    f[np.abs((t - 2 + 1.9) % 3.8123 - 1.9) < 0.25] -= 0.05
    w = rng.uniform(0.5, 2, 150) / 0.01**2
    periods, durations, width = boxsearch.period_grid(30.0, count=150), [0.4, 0.6], 0.1
    got = boxsearch.search(t, f, w, periods, durations)
    for i, p in enumerate(periods):
        turns, bins, best = math.ceil(p / width), np.floor((t - np.floor(t / p) * p) / width).astype(int), None
        for k in (4, 6):
            for start in range(turns):
                inside = (bins - start) % turns < k
                if k < turns and 2 <= inside.sum() < 150:
                    depth = (w * f)[~inside].sum() / w[~inside].sum() - (w * f)[inside].sum() / w[inside].sum()
                    power = depth / math.sqrt(1 / w[inside].sum() + 1 / w[~inside].sum())
                    if depth > 0 and (best is None or power > best + 1e-9):
                        best = power
        assert (best is None and math.isnan(got["power"][i])) or got["power"][i] == pytest.approx(best, rel=1e-7)
    assert abs(periods[np.nanargmax(got["power"])] / 3.8123 - 1) < 0.02
    grid = boxsearch.period_grid(27.4)
    assert len(grid) == 2000 and grid[0] == pytest.approx(0.5) and grid[-1] == pytest.approx(13.7) and len(boxsearch.period_grid(274.0)) > 20_000
    long = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, f))], LONG)
    assert abs(boxsearch.signals(long, None, durations).first().period / 3.8123 - 1) < 0.01


def test_distinct_peaks():
    assert boxsearch.distinct_peaks(np.array([1.0, 2.0, 4.0, 3.0, 7.0]), np.array([5.0, 9.0, 8.0, 4.0, np.nan]), 3) == [1, 3]


def test_contrast_of_equal_powers_is_that_of_the_shortest_period(spark):
    # A box of the same samples at two periods, whose sums differ in their last bits.
    periods, powers = np.array([2.5, 5.0, 7.0, 10.0]), np.array([0.9, 3.0, 0.2, 3.0 + 5e-16])
    assert powers[3] > powers[1]
    rows = spark.createDataFrame([(1, float(p), float(x)) for p, x in zip(periods, powers)], "target_id long, period double, power double")
    assert fold.power_contrast(rows).first().contrast == pytest.approx(15.0) == boxsearch.contrast(periods, powers)


def test_a_single_dip_does_not_hide_behind_its_alias(spark):
    rows = [(1, i, i * 0.1, 1 - 0.05 * (abs(i * 0.1 - 9) < 0.4) + 0.001 * (-1) ** i) for i in range(300)]
    s = spark.createDataFrame(rows, LONG)
    events = single.strongest_events(single.box_scan(s, [0.8]))
    signal = spark.createDataFrame([(1, 7.0, 2.0, 0.8)], "target_id long, period double, epoch double, duration double")
    assert single.not_periodic(events, signal).count() < events.count() == single.not_periodic(events, signal, series=s).count()


def test_views_fill_gaps_and_measure_in_depths(spark, two):
    signals = boxsearch.signals(two, PERIODS, DURATIONS)
    got = {r.target_id: r for r in views.as_arrays(views.make_views(two, signals, 51, 21)).collect()}
    assert set(got) == {1, 2} and len(got[1]["global"]) == 51 and all(len(got[1][v]) == 21 for v in ("local", "odd", "even", "secondary"))
    assert min(got[1]["local"]) == pytest.approx(-1) and abs(np.median(got[1]["global"])) < 0.2 and abs(got[1]["secondary"][10]) < 0.5


def test_scores_that_are_no_numbers_come_last(spark):
    rows = [(1, 0.9), (0, None), (1, float("nan")), (0, 0.5), (1, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    assert evaluate.average_precision(df).first().ap == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    many = [(int(x), float(y)) for x, y in zip(np.random.default_rng(0).integers(0, 2, 500), np.random.default_rng(1).random(500).round(2))]
    auc = np.mean([(a > b) + (a == b) / 2 for x, a in many if x for z, b in many if not z])
    assert evaluate.roc_auc(spark.createDataFrame(many, "label int, score double")).first().auc == pytest.approx(auc)


def test_features_of_nothing(spark):
    empty = spark.createDataFrame([], LONG)
    assert features.extract(empty, boxsearch.signals(empty, PERIODS, DURATIONS)).collect() == []


def test_second_signal_is_found_after_the_first_is_masked(spark):
    a, b = dips(1, n=1500, depth=0.05, noise=0.0005), dips(1, n=1500, period=6.5, epoch=2.0, depth=0.02, noise=0.0)
    both = spark.createDataFrame([(1, i, t, f + g - 1) for (_, i, t, f), (_, _, _, g) in zip(a, b)], LONG)
    got = features.iterative_search(both, [3.3, 4.1, 5.0, 5.7, 6.5, 7.3, 8.9], DURATIONS, threshold=1.0, rounds=2, floor=5).orderBy("round").collect()
    assert [(r.round, r.period) for r in got] == [(1, 5.0), (2, 6.5)]


def test_flattening_takes_a_trend_out_and_keeps_dips(spark):
    rows = [(k, i, t, (f + 0.1 * math.sin(t / 3)) * 7) for k, i, t, f in dips(1, depth=0.01, length=0.3, noise=0.0005)]
    rows[50] = (*rows[50][:3], rows[50][3] * 1.5)  # a flare
    got = detrend.flattened(spark.createDataFrame(rows, LONG), spacing=2.0).orderBy("time").collect()
    assert [r.sample_id for r in got] == list(range(400)) and got[50].clipped and sum(r.clipped for r in got) < 10
    x = [abs((r.time - 1.0 + 2.5) % 5.0 - 2.5) for r in got]
    out = [r.flux for r, a in zip(got, x) if a > 0.3 and r.sample_id != 50]
    assert max(abs(f - 1) for f in out) < 0.005
    assert statistics.mean(r.flux for r, a in zip(got, x) if a < 0.1) == pytest.approx(0.99, abs=0.003)


def test_flattening_leaves_short_and_zero_series_out(spark):
    rows = dips(1, n=10) + [(2, i, float(i), 0.0) for i in range(100)]
    assert detrend.flattened(spark.createDataFrame(rows, LONG)).collect() == []


def test_splines_add_up_to_one_and_hold_cubics():
    x = np.sort(np.random.default_rng(0).uniform(0, 9, 200))
    b = detrend.spline_columns(x, 2.0)
    assert np.allclose(b.sum(1), 1)
    fit, _ = detrend.robust_fit(b, y := 1 + x - 0.2 * x**2 + 0.01 * x**3, np.ones(200, bool))
    assert np.allclose(fit, y)


def test_dominant_period(spark):
    rows = [(1, i, i * 0.1, 1 + 0.1 * math.sin(2 * math.pi * i * 0.1 / 2.7)) for i in range(300)] + [(2, i, float(i), 1.0) for i in range(5)]
    got = {r.target_id: r for r in detrend.dominant_period(spark.createDataFrame(rows, LONG), 0.5, 5.0).collect()}
    assert got[1].period == pytest.approx(2.7, rel=0.01) and got[1].power > 0.99
    assert got[2].period is None or math.isnan(got[2].period)


def test_strongest_events_do_not_overlap(spark, two):
    scan = single.box_scan(two, DURATIONS)
    got = single.strongest_events(scan, 5.0).collect()
    for k in (1, 2):
        left, taken = sorted((-r.snr, r.time, r.duration) for r in scan.collect() if r.target_id == k and r.snr >= 5.0), []
        for m, t, d in left:
            if len(taken) < 4 and all(abs(t - u) >= (d + e) / 2 for _, u, e in taken):
                taken.append((m, t, d))
        assert sorted((-r.snr, r.time, r.duration) for r in got if r.target_id == k) == taken
    duo = single.duo_periods(single.strongest_events(scan, 5.0), two)
    assert duo.filter("target_id = 1 AND abs(period - 5.0) < 0.2").count() > 0


def test_store_computes_only_what_is_new(spark, two):
    seen = []

    def compute(x):
        seen.append(sorted(r.target_id for r in x.select("target_id").distinct().collect()))
        return x.groupBy("target_id").agg(F.avg("flux").alias("m"))

    known = store.update(two.filter("target_id = 1"), None, compute, "1").withColumn("written", F.lit(1)).cache()
    assert {r.target_id for r in store.update(two, known, compute, "1").collect()} == {1, 2}
    store.update(two, known, compute, "2").collect()  # another version: nothing is known
    changed = two.withColumn("flux", F.when((F.col("target_id") == 1) & (F.col("sample_id") == 3), 5.0).otherwise(F.col("flux")))
    store.update(changed, known, compute, "1").collect()
    assert seen == [[1], [2], [1, 2], [1, 2]]


def test_csv_series(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,FLUX\n1,2\n0,4\nx,9\n1,8\n2,\n3,4\n")
    got = files.read_csv_series(spark, str(tmp_path)).orderBy("time").collect()
    assert [(r.target_id, r.time, r.flux) for r in got] == [("a", 0.0, 1.0), ("a", 1.0, 0.5), ("a", 3.0, 1.0)]
    (tmp_path / "c.csv").write_text("# a note\nflux_err, flux ,time\n0.5,4,0\n,6,1\n")
    both = {(r.target_id, r.time): (r.flux, r.flux_err) for r in files.read_csv_series(spark, str(tmp_path)).collect()}
    assert both["c", 0.0] == (0.8, 0.1) and both["c", 1.0][0] == 1.2 and {k for k in both if k[0] == "a"} == {("a", r.time) for r in got}
    (tmp_path / "b.csv").write_text("when,flux\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv_series(spark, str(tmp_path / "b.csv"))


def test_packed_files(spark, two, tmp_path):
    files.write_packed(two, str(tmp_path / "p"), 4)
    assert sorted((r.target_id, r.time, r.flux) for r in files.read_packed(spark, str(tmp_path / "p"), [2], 4).collect()) == [(k, t, f) for k, _, t, f in sorted(two.collect()) if k == 2]


def test_torn_json_lines_are_dropped(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert sorted(r.a for r in files.read_json_rows(spark, str(tmp_path / "r.jsonl"), "a long").collect()) == [1, 2]


def test_held_out_scores_rank(spark):
    g = np.random.default_rng(3)
    rows = [(i, i % 2, float(g.normal(i % 2 * 2, 1)), None if i % 7 == 0 else float(g.normal())) for i in range(300)]
    got = ranking.trained_scores(spark.createDataFrame(rows, "target_id long, label int, a double, b double"), ["a", "b"], trees=5).collect()
    pos, neg = [r.score for r in got if r.label], [r.score for r in got if not r.label]
    assert len(got) == 300 and sum(p > n for p in pos for n in neg) / len(pos) / len(neg) > 0.85
    assert all(0 <= r.score <= 1 for r in got)


def test_features_take_one_search_and_few_exchanges(spark, two):
    found = features.extract(two, boxsearch.signals(two, PERIODS, DURATIONS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("FlatMapGroupsInArrow") == 1 and "Join" not in plan


def test_features_of_series_with_missing_samples(spark, two):
    holes = two.unionByName(two.limit(40).withColumn("flux", F.lit(None).cast("double"))).unionByName(two.limit(3).withColumn("flux", F.lit(float("nan"))))
    signals = boxsearch.signals(two, PERIODS, DURATIONS)
    plain, torn = ({r.target_id: r for r in features.extract(x, signals).collect()} for x in (two, holes))
    assert all(plain[k][f] == pytest.approx(torn[k][f]) for k in (1, 2) for f in features.FEATURES)
    flat = spark.createDataFrame([(3, i, i * 0.1, 1.0) for i in range(50)], LONG)
    given = spark.createDataFrame([(3, 1, 2.0, 0.5, 0.3, 0.01, 9.0, 2.0)], "target_id long, round int, period double, epoch double, duration double, depth double, sde double, contrast double")
    got = features.extract(flat, given).first()
    assert got.n_transits == 3 and got.log_scatter is None and got.bls_depth_over_scatter is None and got.flux_skew is None


def test_boxes_of_uneven_weights_match_brute_force():
    """Samples without weight are in boxes and outside; some boxes have all the weight."""
    rng = np.random.default_rng(11)
    time, flux, weight = np.sort(rng.uniform(0, 20, 40)), 1 + 0.01 * rng.standard_normal(40), rng.uniform(1, 9, 40)
    weight[::3] = 0
    durations, width = [0.5, 0.75, 1.25], 0.125
    periods = boxsearch.period_grid(20.0, count=60)
    got = boxsearch.search(time, flux, weight, periods, durations)
    for i, p in enumerate(periods):
        turns = int(np.ceil(p / width))
        bins = np.minimum(((time - np.floor(time / p) * p) / width).astype(int), turns - 1)
        best = (0.0,)
        for k in (round(d / width) for d in durations):
            for start in range(turns if k < turns else 0):
                box = np.isin(bins, [(start + j) % turns for j in range(k)])
                w, rest = weight[box].sum(), weight[~box].sum()
                if box.sum() < 2 or w == 0 or rest == 0:
                    continue
                depth = (weight * flux)[~box].sum() / rest - (weight * flux)[box].sum() / w
                power = round(depth / np.sqrt(1 / w + 1 / rest), 9)
                if power > best[0]:
                    best = power, depth, box.sum(), k, start
        if len(best) == 1:
            assert np.isnan(got["power"][i])
        else:
            assert np.allclose([got[c][i] for c in ("power", "depth", "n", "k", "start")], best, atol=1e-8)


def test_searched_features_are_those_of_the_signals_found_after_one_exchange(spark, two):
    odd = spark.createDataFrame([(8, 0.1 * i, 1.0) for i in range(50)] + [(9, 0.0, 1.0), (9, 1.0, 0.9)], "target_id long, time double, flux double")
    rows = two.select("target_id", "time", "flux").unionByName(odd)
    # Clipped samples are searched but not measured; those without a flux are neither.
    rows = rows.withColumn("clipped", F.pmod(F.hash("time"), F.lit(10)) == 0)
    torn = rows.unionByName(rows.limit(3).withColumns({"time": F.col("time") + 0.01, "flux": F.lit(float("nan"))}))
    asked, found = features.extract(rows, boxsearch.signals(rows, PERIODS, DURATIONS)), features.searched(rows, PERIODS, DURATIONS)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    asked, got = ({r.target_id: r for r in x.collect()} for x in (asked, found))
    assert set(got) == set(asked) and got and asked.keys().isdisjoint({8, 9})
    for k, r in asked.items():
        assert all((got[k][c] is None) == (r[c] is None) and (r[c] is None or np.isclose(got[k][c], r[c], rtol=1e-9, atol=1e-12)) for c in r.asDict() if c != "target_id")
    kept = {r.target_id: r.period for r in features.searched(torn, PERIODS, DURATIONS).collect()}
    assert kept == {k: r.period for k, r in got.items()}


def test_blocks_of_a_sparse_series_stay_in_the_cache():
    rng = np.random.default_rng(5)
    time, flux = np.sort(rng.uniform(0, 30, 67)), 1 + 0.1 * rng.standard_normal(67)
    tracemalloc.start()
    found = boxsearch.search(time, flux, np.full(67, 1 / flux.var()), boxsearch.period_grid(29.5), [0.5, 0.75, 1.0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(found["power"]).mean() > 0.9 and peak < 1_800_000
