"""Queries at a fixed ephemeris, and over trial periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import boxsearch, fold, views
from tidewatch.operators import series as S
from tidewatch.plans.catalogue import query
from tidewatch.plans.series_queries import GAP, N, E
from tidewatch.sources.tables import event_series

P, T0, D = 7.0, 1.3, 1.0
PERIODS, DURATIONS = [2.5, 3.0, 4.0, 5.0, 6.0, 7.0, 8.5, 10.0], [0.5, 0.75, 1.0]

PHASE = f"(time - {T0} + {P} / 2) - {P} * floor((time - {T0} + {P} / 2) / {P}) - {P} / 2"
B = N + f", p AS (SELECT *, {PHASE} AS phase, round_even((time - {T0}) / {P}, 0)::BIGINT AS event, (time - {T0} - {P} / 2 + {P} / 2) - {P} * floor((time - {T0} - {P} / 2 + {P} / 2) / {P}) - {P} / 2 AS half FROM f)"
DEPTHS = B + f""", b AS (SELECT target_id, avg(flux) AS b FROM p WHERE abs(phase) >= {D} / 2 AND abs(half) >= {D} / 2 GROUP BY 1),
d AS (SELECT p.target_id, event, b.b - avg(flux) AS depth, 1 / sqrt(count(*)) AS error, count(*) AS n FROM p JOIN b ON b.target_id = p.target_id WHERE abs(phase) < {D} / 2 GROUP BY 1, 2, b.b)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalised(S.finite(event_series(spark, sf_dir)))


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_series() for searches, which cost far more than the bytes of a series."""
    return S.normalised(S.dealt(S.finite(event_series(spark, sf_dir)).filter("target_id IS NOT NULL")))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"WITH {B} SELECT sample_id, round(phase, 6) AS phase, event, abs(phase) < {D} / 2 AS in_box FROM p")
def fold_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.folded(_series(spark, sf_dir), P, T0, D).select("sample_id", "phase", "event", "in_box"), "phase")


@query(f"WITH {B}, c AS (SELECT target_id, event, count(*) AS n FROM p WHERE abs(phase) < {D} / 2 GROUP BY 1, 2) SELECT target_id, count(*)::BIGINT AS n_events, min(n)::BIGINT AS least FROM c GROUP BY 1")
def epoch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.epoch_counts(_series(spark, sf_dir), P, T0, D)


@query(f"WITH {DEPTHS} SELECT target_id, event, round(depth, 6) AS depth, round(error, 6) AS error, n::BIGINT AS n FROM d")
def event_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.event_depths(_series(spark, sf_dir), P, T0, D), "depth", "error")


CHI = "sqrt(greatest(sum(depth * depth / (error * error)) - sum(depth / (error * error)) ** 2 / sum(1 / (error * error)), 0) / (count(*) - 1))"


@query(f"WITH {DEPTHS} SELECT target_id, count(*)::BIGINT AS n, CASE WHEN count(*) > 1 THEN round({CHI}, 6) END AS birge FROM d GROUP BY 1")
def birge_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.birge_ratio(fold.event_depths(_series(spark, sf_dir), P, T0, D), ["target_id"]), "birge")


@query(f"""WITH {DEPTHS}, t AS (SELECT target_id, sum(n) AS w, sum(n * depth) AS d, count(*) AS k FROM d GROUP BY 1)
SELECT d.target_id, round(min(CASE WHEN k > 1 THEN (t.d - n * depth) / sqrt(w - n) END), 6) AS snr FROM d JOIN t ON t.target_id = d.target_id GROUP BY 1""")
def loo_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.leave_one_out_snr(fold.event_depths(_series(spark, sf_dir), P, T0, D)), "snr")


@query(f"""WITH {DEPTHS}, s AS (SELECT target_id, sum(n) FILTER (event % 2 <> 0) AS wo, sum(n * depth) FILTER (event % 2 <> 0) AS x, sum(n) FILTER (event % 2 = 0) AS we, sum(n * depth) FILTER (event % 2 = 0) AS y FROM d GROUP BY 1)
SELECT target_id, round(abs(x / wo - y / we) / sqrt(1 / wo + 1 / we), 6) AS sigma FROM s""")
def odd_even_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.odd_even_sigma(fold.event_depths(_series(spark, sf_dir), P, T0, D)), "sigma")


@query(f"""WITH {B}, k AS (SELECT t.target_id, r.r::INT AS bin FROM (SELECT DISTINCT target_id FROM f) t, range(10) r(r)),
g AS (SELECT target_id, floor((phase + 2) / 0.4)::INT AS bin, avg(flux) AS mean, count(*) AS n FROM p WHERE abs(phase) < 2 GROUP BY 1, 2)
SELECT k.target_id, k.bin, round(mean, 5) AS mean, coalesce(n, 0)::BIGINT AS n FROM k LEFT JOIN g ON g.target_id = k.target_id AND g.bin = k.bin""")
def folded_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.folded_profile(_series(spark, sf_dir), P, T0, 2.0, 10), "mean", digits=5)


@query(f"""WITH {B}, k AS (SELECT t.target_id, r.r::INT AS bin, -2 + (r.r + 0.5) * 0.4 AS c FROM (SELECT DISTINCT target_id FROM f) t, range(10) r(r))
SELECT k.target_id, k.bin, round(median(flux), 6) AS median FROM k LEFT JOIN p ON p.target_id = k.target_id AND abs(p.phase - k.c) <= 0.3 GROUP BY 1, 2""")
def binned_median_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.binned_median_view(_series(spark, sf_dir), P, T0, 2.0, 10, 0.6), "median")


W = min(DURATIONS) / 4
POWERS = N + f""", t AS (SELECT unnest({PERIODS}::DOUBLE[]) AS period), q AS (SELECT target_id, period, floor((time - floor(time / period) * period) / {W})::BIGINT AS bin, flux FROM f, t),
g AS (SELECT target_id, period, bin, count(*) AS n, sum(flux) AS s FROM q GROUP BY 1, 2, 3), a AS (SELECT target_id, count(*) AS an, sum(flux) AS al, var_pop(flux) AS v FROM f GROUP BY 1),
st AS (SELECT DISTINCT target_id, period, k, ((g.bin - o.o) % ceil(period / {W})::BIGINT + ceil(period / {W})::BIGINT) % ceil(period / {W})::BIGINT AS start FROM g, (SELECT unnest({[round(d / W) for d in DURATIONS]}) AS k), range(40) o(o) WHERE o.o < k),
x AS (SELECT st.target_id, st.period, k, st.start, sum(n) AS n, sum(s) AS s FROM st JOIN g ON g.target_id = st.target_id AND g.period = st.period AND ((g.bin - st.start) % ceil(st.period / {W})::BIGINT + ceil(st.period / {W})::BIGINT) % ceil(st.period / {W})::BIGINT < k GROUP BY 1, 2, 3, 4),
y AS (SELECT x.*, (al - s) / (an - n) - s / n AS depth, ((al - s) / (an - n) - s / n) / sqrt(v * (1 / n + 1 / (an - n))) AS power FROM x JOIN a ON a.target_id = x.target_id WHERE n < an AND n >= 2 AND v > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY target_id, period ORDER BY round(power, 9) DESC, k, start) AS r FROM y WHERE depth > 0), best AS (SELECT * FROM w WHERE r = 1)"""


@query(f"WITH {POWERS} SELECT target_id, period, round(power, 6) AS power, round(depth, 6) AS depth, (k * {W})::DOUBLE AS duration, (start * {W})::DOUBLE AS phase0 FROM best")
def box_search_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(boxsearch.box_search(_series(spark, sf_dir), PERIODS, DURATIONS), "power", "depth")


@query(f"""WITH {POWERS}, pm AS (SELECT target_id, median(power) AS mid, max(power) AS top, count(*) AS found FROM best GROUP BY 1),
pd AS (SELECT b.target_id, median(abs(power - mid)) * 1.4826 AS dev, any_value(mid) AS mid, any_value(top) AS top, any_value(found) AS found FROM best b JOIN pm ON pm.target_id = b.target_id GROUP BY 1)
SELECT target_id, CASE WHEN found >= 5 AND dev > 0 THEN round((top - mid) / dev, 5) END AS sde FROM pd""")
def detection_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.detection_efficiency(boxsearch.box_search(_series(spark, sf_dir), PERIODS, DURATIONS), least=5), "sde", digits=5)


@query(f"""WITH {POWERS}, top AS (SELECT target_id, power AS x, period AS p FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY power DESC, period) AS rk FROM best) WHERE rk = 1)
SELECT b.target_id, round(any_value(x) / max(power) FILTER (abs(period / (0.5 * p) - 1) > 0.1 AND abs(period / p - 1) > 0.1 AND abs(period / (2 * p) - 1) > 0.1 AND abs(period / (3 * p) - 1) > 0.1), 6) AS contrast
FROM best b JOIN top ON top.target_id = b.target_id GROUP BY 1""")
def power_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.power_contrast(boxsearch.box_search(_series(spark, sf_dir), PERIODS, DURATIONS)), "contrast")


@query(f"""WITH {N}, b AS (SELECT target_id, floor(time / 1.5) AS b, avg(flux) AS m, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 2),
g AS (SELECT target_id, stddev_pop(m) AS d, avg(n) AS c, count(*) AS b FROM b GROUP BY 1), c AS (SELECT target_id, median(flux) AS c FROM f GROUP BY 1),
s AS (SELECT f.target_id, median(abs(flux - c)) * 1.4826 AS s, count(*) AS n FROM f JOIN c ON c.target_id = f.target_id GROUP BY 1)
SELECT s.target_id, CASE WHEN n >= 20 AND b >= 4 AND s > 0 THEN round(d / (s / sqrt(g.c)), 6) END AS beta FROM s LEFT JOIN g ON g.target_id = s.target_id""")
def red_noise_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.red_noise(_series(spark, sf_dir), 1.5), "beta")


@query()
def box_search_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best boxes over each series' own grid of 2,000 periods or more: too many for SQL; the test holds the search
    against brute force off the grid of box_search_grid."""
    return boxsearch.signals(_searched(spark, sf_dir), None, DURATIONS).drop("round")


V = {"global": (P / 2, 20, P / 20), "local": (3.5, 12, 0.8), "odd": (3.5, 12, 0.8), "even": (3.5, 12, 0.8), "secondary": (3.5, 12, 0.8)}


@query(f"""WITH {B}, g AS (SELECT v.view, v.half, v.width, v.bins, b.b::INT AS bin, -v.half + (b.b + 0.5) * 2 * v.half / v.bins AS c
  FROM (VALUES {", ".join(f"('{n}', {h}::DOUBLE, {k}, {w}::DOUBLE)" for n, (h, k, w) in V.items())}) v(view, half, bins, width), range(20) b(b) WHERE b.b < v.bins),
y AS (SELECT target_id, flux - 1 AS y, phase, half, event FROM p), lv AS (SELECT target_id, coalesce(median(y) FILTER (abs(phase) > {D}), 0) AS level FROM y GROUP BY 1),
sc AS (SELECT y.target_id, median(abs(y - level)) * 1.4826 AS s FROM y JOIN lv ON lv.target_id = y.target_id WHERE abs(phase) > {D} GROUP BY 1),
mm AS (SELECT lv.target_id, g.view, g.bin, any_value(level) AS level, median(y) AS m FROM lv CROSS JOIN g LEFT JOIN y ON y.target_id = lv.target_id
  AND CASE g.view WHEN 'secondary' THEN abs(y.half - g.c) WHEN 'odd' THEN CASE WHEN y.event % 2 <> 0 THEN abs(y.phase - g.c) END WHEN 'even' THEN CASE WHEN y.event % 2 = 0 THEN abs(y.phase - g.c) END ELSE abs(y.phase - g.c) END <= g.width / 2 GROUP BY 1, 2, 3),
n AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS a, last_value(m IGNORE NULLS) OVER a AS ma, first_value(CASE WHEN m IS NOT NULL THEN bin END IGNORE NULLS) OVER z AS z, first_value(m IGNORE NULLS) OVER z AS mz FROM mm
  WINDOW a AS (PARTITION BY target_id, view ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY target_id, view ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f2 AS (SELECT target_id, view, bin, coalesce(m, ma + (mz - ma) * (bin - a) / nullif(z - a, 0), ma, mz, level) - level AS v FROM n),
dp AS (SELECT f2.target_id, CASE WHEN min(v) FILTER (view = 'local') < 0 THEN -min(v) FILTER (view = 'local') WHEN any_value(s) > 0 THEN any_value(s) ELSE 1 END AS d FROM f2 LEFT JOIN sc ON sc.target_id = f2.target_id GROUP BY 1)
SELECT f2.target_id, view, bin, round(v / d, 4) AS value FROM f2 JOIN dp ON dp.target_id = f2.target_id""")
def five_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _series(spark, sf_dir)
    signals = f.select("target_id").distinct().withColumns({"period": F.lit(P), "epoch": F.lit(T0), "duration": F.lit(D)})
    return _rounded(views.make_views(f, signals, 20, 12, bin_width=0.8), "value", digits=4)


@query(f"""WITH {N}, w AS (SELECT *, time - lag(time) OVER (PARTITION BY target_id ORDER BY time) AS d FROM f), o AS (SELECT target_id, median(d) AS c, stddev_pop(flux) AS s FROM w GROUP BY 1),
g AS (SELECT target_id, time, flux, sum(coalesce((d > 1.0)::INT, 0)) OVER (PARTITION BY target_id ORDER BY time) AS segment FROM w), i AS (SELECT *, time - min(time) OVER (PARTITION BY target_id, segment) AS x FROM g),
b AS (SELECT target_id, l.l AS level, segment, floor(x / (0.7::DOUBLE * pow(2, l.l))) AS j, count(*) AS n, avg(flux) AS m FROM i, range(4) l(l) GROUP BY 1, 2, 3, 4),
v AS (SELECT b.target_id, level, count(*) AS k, stddev_pop(m) AS v, avg(n) AS c, any_value(s) AS s FROM b JOIN o ON o.target_id = b.target_id WHERE 0.7::DOUBLE * pow(2, level) / o.c >= 2 AND n >= 0.75 * 0.7::DOUBLE * pow(2, level) / o.c GROUP BY 1, 2 HAVING count(*) >= 4),
r AS (SELECT target_id, median(v / (s / sqrt(c) * sqrt(k / (k - 1.0::DOUBLE)))) AS r, count(*) AS n FROM v WHERE s > 0 GROUP BY 1)
SELECT o.target_id, round(greatest(coalesce(r, 1), 1), 6) AS beta, coalesce(n, 0)::BIGINT AS n_widths FROM o LEFT JOIN r ON r.target_id = o.target_id""")
def time_averaging_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fold.time_averaging(_series(spark, sf_dir), 0.7, 3, 1.0, least=4), "beta")
