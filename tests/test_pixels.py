"""Centroids of difference images against numpy, planted sources, and calibration on noise."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import pixels

CUBE = "target_id long, sector int, time double, pixels array<double>, period double, epoch double, duration double"


def cube(target, sector, source, events=8, seed=0, depth=0.05, noise=0.3):
    """A 6 by 5 stamp with a bright star at (2, 2) and light that dips at `source`."""
    rng = np.random.default_rng([seed, target, sector])
    c, r = np.meshgrid(np.arange(6), np.arange(5))
    blob = lambda at, s: s * np.exp(-((c - at[0]) ** 2 + (r - at[1]) ** 2) / 1.2)
    out = []
    for t in np.arange(0, events * 4.0, 0.1):
        x = abs((t - 2.0 + 2.0) % 4.0 - 2.0)
        image = blob((2, 2), 1000) + blob(source, 400) * (1 - depth * (x < 0.4)) + rng.normal(0, noise, (5, 6))
        out.append((target, sector, float(t), [float(v) for v in image.ravel()], 4.0, 2.0, 0.8))
    return out


def by_numpy(rows, inner=0.8, near=1.0, far=2.5, x=2.0, y=2.0, radius=2.5):
    c, r = np.meshgrid(np.arange(6), np.arange(5))
    w = ((c - x) ** 2 + (r - y) ** 2 <= radius**2).ravel()
    events = {}
    for _, _, t, p, period, epoch, d in rows:
        p = np.array(p, float)[w]
        if np.isnan(p).any():
            continue
        k = round((t - epoch) / period)
        away = abs((t - epoch + period / 2) % period - period / 2)
        side = "i" if away < inner * d / 2 else "o" if near * d <= away <= far * d else None
        if side:
            events.setdefault(k, {"i": [], "o": []})[side].append([p.sum(), (p * c.ravel()[w]).sum(), (p * r.ravel()[w]).sum()])
    events = [(np.mean(e["o"], 0), np.mean(e["i"], 0)) for e in events.values() if e["i"] and e["o"]]
    o, d = np.array([e[0] for e in events]), np.array([e[0] - e[1] for e in events])
    whole = lambda keep: d[keep].mean(0)[1:] / d[keep].mean(0)[0] - o[keep].mean(0)[1:] / o[keep].mean(0)[0]
    every = np.arange(len(d))
    left_out = np.array([whole(every != k) for k in every])
    return whole(every >= 0), np.cov(left_out, rowvar=False) * (len(d) - 1) ** 2 / len(d)


def measured(spark, rows, **more):
    sums = pixels.image_sums(spark.createDataFrame(rows, CUBE), 6, 2.0, 2.0, 2.5)
    return pixels.centroid_test(pixels.difference_events(sums, ["target_id", "sector"]), ["target_id", "sector"], **more)


def test_offsets_against_numpy_and_a_planted_neighbour(spark):
    on, off = cube(1, 1, (2, 2)), cube(2, 1, (3.4, 2))
    hole = [float("nan"), *off[13][3][1:]], [None if i == 14 else v for i, v in enumerate(off[14][3])]
    off[13], off[14] = (*off[13][:3], hole[0], *off[13][4:]), (*off[14][:3], hole[1], *off[14][4:])
    got = {r.target_id: r for r in measured(spark, on + off).collect()}
    off[14] = (*off[14][:3], [float("nan") if v is None else v for v in off[14][3]], *off[14][4:])
    for k, rows in ((1, on), (2, off)):
        offset, cov = by_numpy(rows)
        assert (got[k].dx, got[k].dy) == pytest.approx(tuple(offset), rel=1e-9, abs=1e-12)
        assert (got[k].xx, got[k].xy, got[k].yy) == pytest.approx((cov[0, 0], cov[0, 1], cov[1, 1]), rel=0.15, abs=1e-7)  # leaving one out is not quite linear
    assert got[1].status == got[2].status == "ok" and not got[1].significant and got[2].significant and got[2].dx > 0.5 and got[2].offset_sigma > 5


def test_significance_is_calibrated_on_noise(spark):
    rows = [r for k in range(60) for r in cube(k, 1, (2, 2), events=6, seed=3, noise=2.0)]
    p = [math.exp(r.log_p) for r in measured(spark, rows).collect() if r.log_p is not None]
    assert len(p) == 60 and 0.3 < np.mean(np.array(p) < 0.5) < 0.7 and np.mean(np.array(p) < 0.05) < 0.2


def test_sigma_of_log_p(spark):
    ps = [0.9, 0.5, 0.0027, 1e-9, 1e-300]
    got = [r[0] for r in spark.createDataFrame([(math.log(p),) for p in ps] + [(0.0,), (None,), (-5000.0,)], "lp double").select(pixels.sigma_of_log_p(F.col("lp"))).collect()]
    wanted = [-statistics.NormalDist().inv_cdf(p / 2) for p in ps]
    assert got[:5] == pytest.approx(wanted, rel=1e-5) and got[5:7] == [0.0, None] and got[7] == pytest.approx(99.95, abs=0.05)


def test_cubes_of_one_star_are_combined(spark):
    rows = [r for s in range(4) for r in cube(1, s, (3.0, 2), events=5, depth=0.02, noise=1.0)] + cube(2, 0, (2, 2), events=2) + [r for s in range(3) for r in cube(3, s, (2, 2), noise=1.0)]
    tests = measured(spark, rows)
    each = [r for r in tests.collect() if r.target_id == 1 and r.status == "ok" and r.distance <= 5]
    got = {r.target_id: r for r in pixels.combined_tests(tests, ["target_id"]).collect()}
    w = [np.linalg.inv([[r.xx, r.xy], [r.xy, r.yy]]) for r in each]
    mean = np.linalg.solve(sum(w), sum(m @ [r.dx, r.dy] for m, r in zip(w, each)))
    assert (got[1].dx, got[1].dy) == pytest.approx(tuple(mean)) and got[1].n_placed == len(each) >= 3
    z = np.zeros(2)
    for r in each:
        a = np.linalg.solve(np.linalg.cholesky([[r.xx, r.xy], [r.xy, r.yy]]), [r.dx, r.dy])
        z += a / np.linalg.norm(a) * math.sqrt(-2 * r.log_p)
    assert got[1].log_p == pytest.approx(-(z @ z) / len(each) / 2) and got[1].significant and not got[3].significant
    assert got[2].n_placed == 0 and got[2].dx is None and not got[2].significant
    one = next(r for r in tests.collect() if r.target_id == 3 and r.sector == 0)
    alone = pixels.combined_tests(tests.filter("target_id = 3 AND sector = 0"), ["target_id"]).first()
    assert (alone.dx, alone.dy, alone.log_p) == pytest.approx((one.dx, one.dy, one.log_p))


def test_nothing_to_measure(spark):
    assert measured(spark, []).count() == 0
    flat = [(1, 1, t * 0.1, [1.0] * 30, 4.0, 2.0, 0.8) for t in range(300)]
    bad = [(2, 1, t * 0.1, [None] * 30, 4.0, 2.0, 0.8) for t in range(300)] + [(3, 1, t * 0.1, [1.0] * 30, 0.0, 2.0, 0.8) for t in range(30)]
    got = measured(spark, flat + bad).collect()
    assert [(r.target_id, r.status, r.significant) for r in got] == [(1, "weak", False)]
