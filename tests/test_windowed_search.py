"""Searches of long series through their densest window, against the scan of every box and planted signals."""

import numpy as np
import pytest

from tidewatch.operators import boxsearch, dips, windowed

LONG = "target_id long, time double, flux double"


def series(period, epoch, spans, depth=0.01, duration=0.3, noise=1e-3, step=0.05, seed=0):
    time = np.concatenate([np.arange(a, b, step) for a, b in spans])
    x = (time - epoch + period / 2) % period - period / 2
    return time, 1 - depth * (np.abs(x) < duration / 2) + noise * np.random.default_rng(seed).standard_normal(len(time))


def test_densest_window_and_leave_one_out_by_hand():
    rng = np.random.default_rng(1)
    time = np.sort(np.concatenate([rng.uniform(0, 100, 150), rng.uniform(40, 50, 120)]))
    start, stop = windowed.densest(time, 10.0)
    assert stop - start == 10.0 and ((time >= start) & (time <= stop)).sum() == max(((time >= a) & (time <= a + 10)).sum() for a in time)
    t, f = series(5.0, 1.0, [(0, 40)])
    w = np.full(len(t), 1 / f.var())
    snr, n = windowed.without_strongest(t, f, w, 5.0, 1.0, 0.3)
    k, x = np.rint((t - 1) / 5), (t - 1 + 2.5) % 5 - 2.5
    base = f[(np.abs(x) >= 0.15) & (np.abs(np.abs(x) - 2.5) >= 0.15)].mean()
    each = [(w[0] * (np.abs(x[k == e]) < 0.15).sum(), w[0] * (base - f[(k == e) & (np.abs(x) < 0.15)]).sum()) for e in range(8)]
    assert n == 8 and snr == pytest.approx(min(sum(d for j, (_, d) in enumerate(each) if j != i) / np.sqrt(sum(v for j, (v, _) in enumerate(each) if j != i)) for i in range(8)))


def test_a_signal_in_two_windows_gets_the_precision_of_the_whole(spark):
    t, f = series(7.3013, 2.0, [(0, 40), (300, 325), (500, 520)])
    w = np.full(len(t), 1 / f.var())
    got = windowed.windowed(t, f, w, [0.2, 0.3, 0.45], 40.0)
    alone = boxsearch.search(t[t < 40], f[t < 40], w[t < 40], boxsearch.period_grid(40.0), [0.2, 0.3, 0.45])
    rough = boxsearch.period_grid(40.0)[np.nanargmax(alone["power"])]
    assert abs(got["period"] / 7.3013 - 1) < 1.5e-4 and abs(got["period"] / 7.3013 - 1) <= abs(rough / 7.3013 - 1) + 1e-9
    assert (got["window_start"], got["n_events"]) == (0.0, len({round((x - 2) / 7.3013) for x in t if abs((x - 2 + 3.65065) % 7.3013 - 3.65065) < 0.1}))
    table = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, f)] + [(2, 1.0, 1.0), (3, None, 1.0)] + [(4, float(i), 1.0) for i in range(50)], LONG)
    rows = windowed.windowed_search(table, [0.2, 0.3, 0.45], 40.0).collect()
    assert [(r.target_id, r.period) for r in rows] == [(1, pytest.approx(got["period"]))]


def test_one_deep_event_does_not_win():
    t, f = series(4.0, 1.0, [(0, 40)], depth=0.004, noise=5e-4)
    f[np.abs(t - 22.4) < 0.15] -= 0.012
    got = windowed.windowed(t, f, np.full(len(t), 1 / f.var()), [0.2, 0.3, 0.45], 40.0)
    assert min(abs(got["period"] / (4.0 * a) - 1) for a in (0.5, 1, 2)) < 0.01


def test_pairs_find_what_no_window_holds_twice():
    t, f = series(60.0, 10.0, [(0, 30), (60, 85), (125, 140)], depth=0.02)
    w = np.full(len(t), 1 / f.var())
    with_pairs = windowed.windowed(t, f, w, [0.2, 0.3, 0.45], 30.0, pairs=dips.Rules())
    assert abs(with_pairs["period"] / 60.0 - 1) < 0.005 and with_pairs["n_events"] == 3
    without = windowed.windowed(t, f, w, [0.2, 0.3, 0.45], 30.0)
    assert abs(without["period"] / 60.0 - 1) > 0.005


def test_window_longer_than_the_series_is_a_plain_search():
    t, f = series(5.0, 1.0, [(0, 30)])
    w = np.full(len(t), 1 / f.var())
    got = windowed.windowed(t, f, w, [0.3], 400.0)
    plain = boxsearch.search(t, f, w, boxsearch.period_grid(float(t[-1] - t[0])), [0.3])
    assert got["sde"] == pytest.approx(boxsearch.efficiency(plain["power"])) and abs(got["period"] / 5.0 - 1) < 0.01


def test_trials_together_are_those_one_by_one_and_take_three_searches(monkeypatch):
    """The window, all trials about all candidates and pairs, and the winner: three searches a series, however many trials."""
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 30, 70))
    f = 1 + rng.normal(0, 0.1, 70) - 0.8 * (np.abs((t - 1.3) % 5.3) < 0.8)
    w = np.full(70, 1 / f.var())
    p, e, d = rng.uniform(2.5, 7.5, 50), rng.uniform(0, 5, 50), rng.choice([0.5, 1.0], 50)
    score, events = windowed.all_without_strongest(t, f, w, p, e, d)
    for i in range(50):
        x = (t - e[i] + p[i] / 2) % p[i] - p[i] / 2
        inside, number = np.abs(x) < d[i] / 2, np.rint((t - e[i]) / p[i])
        base = np.mean(f[~inside & (np.abs(np.abs(x) - p[i] / 2) >= d[i] / 2)])
        names = np.unique(number[inside])
        assert events[i] == len(names)
        others = [inside & (number != k) for k in names]
        assert len(names) < 2 and np.isnan(score[i]) or score[i] == pytest.approx(min((base - f[o]).sum() * np.sqrt(w[0]) / np.sqrt(o.sum()) for o in others if o.any()), abs=1e-9)
    searches, plain = [], windowed.search
    monkeypatch.setattr(windowed, "search", lambda *a: searches.append(len(a[3])) or plain(*a))
    assert windowed.windowed(t, f, w, [0.5, 0.75, 1.0], 15.0, 3, np.geomspace(1.5, 7.5, 200), dips.Rules(threshold=2.0))["period"] > 0
    assert len(searches) == 3 and searches[1] > 50
