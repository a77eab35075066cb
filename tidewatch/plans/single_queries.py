"""Queries over single dips, physics, and series with dips put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import physics as X
from tidewatch.operators import series as S
from tidewatch.operators import dips, single
from tidewatch.plans.catalogue import query
from tidewatch.plans.fold_queries import _rounded, _searched, _series
from tidewatch.plans.series_queries import E, N
from tidewatch.sources.tables import event_series, table

DURATIONS = [1.0, 2.0, 3.0]
M = N + ", c AS (SELECT target_id, median(flux) AS c FROM f GROUP BY 1), s AS (SELECT f.target_id, any_value(c) AS c, median(abs(flux - c)) * 1.4826 AS s FROM f JOIN c ON c.target_id = f.target_id GROUP BY 1)"
NOISE = "".join(
    f""", b{i} AS (SELECT target_id, floor(time / {d}::DOUBLE) AS b, avg(flux) AS m, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 2), c{i} AS (SELECT target_id, median(m) AS c, count(*) AS k, avg(n) AS n FROM b{i} GROUP BY 1),
    n{i} AS (SELECT s.target_id, greatest(1, CASE WHEN any_value(k) >= 8 AND any_value(s) > 0 THEN median(abs(m - c{i}.c)) * 1.4826 / (any_value(s) / sqrt(any_value(c{i}.n))) ELSE 1 END) AS beta FROM s LEFT JOIN c{i} ON c{i}.target_id = s.target_id LEFT JOIN b{i} ON b{i}.target_id = s.target_id GROUP BY 1)"""
    for i, d in enumerate(DURATIONS)
)
#: Boxes against one duration to each side: at least 2 samples and 0.4 of a duration's, half as many on each side.
SCAN = M + ", st AS (SELECT target_id, median(d) AS st FROM (SELECT target_id, time - lag(time) OVER (PARTITION BY target_id ORDER BY time) AS d FROM f) GROUP BY 1)" + NOISE + ", x AS (" + " UNION ALL ".join(
    f"""SELECT x.target_id, kind, time, {d}::DOUBLE AS duration, n, m, a - n AS nl, z - n AS nr, (sa - sn) + (sz - sn) AS so, beta, greatest(2, 0.4::DOUBLE * {d} / st) AS need FROM (
    SELECT f.target_id, kind, time, count(*) OVER w AS n, avg(flux) OVER w AS m, sum(flux) OVER w AS sn, count(*) OVER l AS a, sum(flux) OVER l AS sa, count(*) OVER r AS z, sum(flux) OVER r AS sz FROM f
    WINDOW w AS (PARTITION BY f.target_id ORDER BY time RANGE BETWEEN {d / 2}::DOUBLE PRECEDING AND {d / 2}::DOUBLE FOLLOWING), l AS (PARTITION BY f.target_id ORDER BY time RANGE BETWEEN {1.5 * d}::DOUBLE PRECEDING AND {d / 2}::DOUBLE FOLLOWING),
    r AS (PARTITION BY f.target_id ORDER BY time RANGE BETWEEN {d / 2}::DOUBLE PRECEDING AND {1.5 * d}::DOUBLE FOLLOWING)) x JOIN n{i} ON n{i}.target_id = x.target_id JOIN st ON st.target_id = x.target_id"""
    for i, d in enumerate(DURATIONS)
) + """), z AS (SELECT x.target_id, kind, time, duration, n, so / (nl + nr) - m AS depth, (so / (nl + nr) - m) / (s * beta * sqrt(1 / n + 1 / (nl + nr))) AS snr FROM x JOIN s ON s.target_id = x.target_id WHERE s > 0 AND n >= need AND nl >= need / 2 AND nr >= need / 2)"""


@query(f"WITH {SCAN} SELECT target_id, round(time, 6) AS time, duration, n::BIGINT AS n, round(depth + 1e-9, 6) + 0.0 AS depth, round(snr + 1e-9, 6) + 0.0 AS snr FROM z")
def single_box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flux has two digits, so that many depths lie between two rounded values; a billionth puts them all above."""
    out = single.box_scan(_series(spark, sf_dir), DURATIONS).withColumns({c: F.col(c) + 1e-9 for c in ("depth", "snr")})
    out = _rounded(out, "time", "depth", "snr")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("depth", "snr")})  # no negative zero


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.strongest_events(single.box_scan(_series(spark, sf_dir), DURATIONS), 1.0)


#: The same choice, one event after the other.
TAKEN = SCAN + "".join(
    f""", t{k} AS (SELECT target_id, {k} AS rank, time, duration, depth, n, snr FROM (SELECT z.*, row_number() OVER (PARTITION BY z.target_id ORDER BY snr DESC, time, duration) AS r FROM z WHERE snr >= 1.0
    AND NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT target_id, time, duration FROM t{j}' for j in range(1, k)) or 'SELECT 0 AS target_id, 0 AS time, 0 AS duration WHERE false'}) t
    WHERE t.target_id = z.target_id AND abs(t.time - z.time) < (t.duration + z.duration) / 2)) WHERE r = 1)"""
    for k in range(1, 5)
) + ", t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4)"


@query(f"WITH {TAKEN} SELECT target_id, rank, round(time, 6) AS time, duration, round(depth, 6) AS depth, n::BIGINT AS n, round(snr, 6) AS snr FROM t")
def single_strongest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_events(spark, sf_dir), "time", "depth", "snr")


@query(f"""WITH {TAKEN}, pr AS (SELECT a.target_id, a.time AS first, b.time AS second, (a.duration + b.duration) / 2 AS d, (a.depth + b.depth) / 2 AS depth, k.k AS k, (b.time - a.time) / k.k AS period
FROM t a JOIN t b ON a.target_id = b.target_id AND a.time < b.time, range(1, 31) k(k)
WHERE abs(a.depth - b.depth) <= 3 * sqrt(pow(a.depth / a.snr, 2) + pow(b.depth / b.snr, 2)) + 0.1 * (a.depth + b.depth)
AND greatest(a.duration, b.duration) <= 1.6 * least(a.duration, b.duration) AND (b.time - a.time) / k.k >= greatest(2, a.duration + b.duration)),
en AS (SELECT target_id, min(time) AS t0, max(time) AS t1 FROM f GROUP BY 1),
ep AS (SELECT pr.*, unnest(range(ceil((t0 - d - first) / period)::BIGINT, floor((t1 + d - first) / period)::BIGINT + 1)) AS j FROM pr JOIN en ON en.target_id = pr.target_id),
bx AS (SELECT ep.target_id, first, second, ep.k, j, any_value(ep.depth) AS depth, any_value(greatest(2, 0.4::DOUBLE * d / st)) AS need, count(*) FILTER (abs(time - (first + j * period)) <= d / 2) AS n, avg(flux) FILTER (abs(time - (first + j * period)) <= d / 2) AS m,
  count(*) FILTER (abs(time - (first + j * period)) > d / 2) AS o, avg(flux) FILTER (abs(time - (first + j * period)) > d / 2) AS q
  FROM ep JOIN st ON st.target_id = ep.target_id JOIN f ON f.target_id = ep.target_id AND abs(f.time - (first + j * period)) <= 1.5 * d WHERE j <> 0 AND j <> ep.k GROUP BY ALL),
ro AS (SELECT DISTINCT target_id, first, second, k FROM bx WHERE n >= need AND o >= need AND q - m < 0.5 * depth)
SELECT pr.target_id, round(pr.first, 6) AS first, round(pr.second, 6) AS second, pr.k::INT AS k, round(period, 6) AS period FROM pr ANTI JOIN ro ON ro.target_id = pr.target_id AND ro.first = pr.first AND ro.second = pr.second AND ro.k = pr.k""")
def single_duo_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without periods that samples at a predicted dip contradict."""
    return _rounded(single.duo_periods(_events(spark, sf_dir), _series(spark, sf_dir)), "first", "second", "period")


@query()
def single_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dips of all series from the scan to their shortest periods, refined and told from ramps; tests hold it against brute force."""
    return single.search_events(_searched(spark, sf_dir), DURATIONS, dips.Rules(threshold=1.5))


@query(f"""WITH {TAKEN} SELECT target_id, rank, round(time, 6) AS time FROM t
WHERE NOT abs(time - 1.3 - 7.0 * round_even((time - 1.3) / 7.0, 0)) < (1.0 + duration) / 2""")
def single_not_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without events in the boxes of a signal that every series is taken to have."""
    e = _events(spark, sf_dir)
    signals = event_series(spark, sf_dir).select("target_id").distinct().withColumns({"period": F.lit(7.0), "epoch": F.lit(1.3), "duration": F.lit(1.0)})
    return _rounded(single.not_periodic(e, signals).select("target_id", "rank", "time"), "time")


@query(f"""WITH {M}, b AS (SELECT target_id, floor(time / 1.5) AS b, avg(flux) AS m, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 2), bc AS (SELECT target_id, median(m) AS c, count(*) AS k, avg(n) AS n FROM b GROUP BY 1),
bs AS (SELECT b.target_id, median(abs(m - bc.c)) * 1.4826 AS d, any_value(k) AS k, any_value(bc.n) AS n FROM b JOIN bc ON bc.target_id = b.target_id GROUP BY 1)
SELECT s.target_id, round(greatest(1, CASE WHEN k >= 8 AND s > 0 THEN d / (s / sqrt(n)) ELSE 1 END), 6) AS beta FROM s LEFT JOIN bs ON bs.target_id = s.target_id""")
def single_noise_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(single.noise_factor(_series(spark, sf_dir), 1.5), "beta")


A = f"pow(rho * (p * 86400.0) * (p * 86400.0) * ({X.G} / (3 * pi())), 1.0 / 3)"


@query(f"""WITH k AS (SELECT p_partkey, p_size * 0.7 + 0.3 AS p, p_retailprice / 1000 AS rho, p_size / 100.0 AS k, (p_partkey % 12) / 10.0 AS b FROM part), a AS (SELECT *, {A} AS a, 5772.0 * pow(pow(rho / 1.41, -1 / 2.1), 0.4) AS t FROM k),
d AS (SELECT *, CASE WHEN (1 + k) ** 2 - b * b <= 0 THEN 0 ELSE p / pi() * asin(least(1, sqrt(greatest((1 + k) ** 2 - b * b, 0)) / a)) END AS o, CASE WHEN (1 - k) ** 2 - b * b <= 0 THEN 0 ELSE p / pi() * asin(least(1, sqrt(greatest((1 - k) ** 2 - b * b, 0)) / a)) END AS i,
CASE WHEN a <= 1 THEN p / 2 ELSE p / pi() * asin(1 / greatest(a, 1)) END AS c FROM a)
SELECT p_partkey, round(a, 6) AS axis, round(o, 6) AS outer_days, round(i, 6) AS inner_days, round(c, 6) AS central_days, round(t, 4) AS temperature, round(1.41 * pow(pow(t / 5772.0, 2.5), -2.1), 6) AS density,
round(least(0.15, (exp({X.BAND} / t) - 1) / (exp({X.BAND} / (t * sqrt(1 / greatest(a, 1)) * pow(2.0 / 3, 0.25))) - 1) + 0.3 / greatest(a, 1) / greatest(a, 1)), 6) AS occultation,
round(c * 86400.0 * c * 86400.0 * c * 86400.0 * rho * (pi() * pi() * {X.G} / 3) / 86400.0, 5) AS period_back FROM d""")
def transit_physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for orbits: size gives the period and radius ratio, price the density of the star."""
    p = table(spark, sf_dir, "part")
    k = p.select("p_partkey", (F.col("p_size") * 0.7 + 0.3).alias("p"), (F.col("p_retailprice") / 1000).alias("rho"), (F.col("p_size") / 100.0).alias("k"), ((F.col("p_partkey") % 12) / 10.0).alias("b"))
    k = k.withColumns({"a": X.axis_ratio(F.col("p"), F.col("rho")), "t": X.main_sequence_temperature(F.col("rho")), "c": X.central_duration(F.col("p"), F.col("rho"))})
    chord = lambda inner: X.chord_duration(F.col("p"), F.col("a"), F.col("k"), F.col("b"), inner)
    return k.select(
        "p_partkey", F.round("a", 6).alias("axis"), F.round(chord(False), 6).alias("outer_days"), F.round(chord(True), 6).alias("inner_days"), F.round("c", 6).alias("central_days"),
        F.round("t", 4).alias("temperature"), F.round(X.main_sequence_density(F.col("t")), 6).alias("density"),
        F.round(X.largest_occultation(F.col("p"), F.col("t"), F.col("rho")), 6).alias("occultation"), F.round(X.period_of_duration(F.col("c"), F.col("rho")), 5).alias("period_back"),
    )


@query(f"""WITH {N}, q AS (SELECT *, abs((time - 1.3 + 3.5) - 7.0 * floor((time - 1.3 + 3.5) / 7.0) - 3.5) AS x FROM f)
SELECT sample_id, round(flux * (1 - 0.2 * greatest(0, least(1, (0.5 - x) / 0.2))), 6) AS flux FROM q""")
def injected_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series with a periodic dip multiplied in."""
    f = _series(spark, sf_dir)
    return f.select("sample_id", F.round(F.col("flux") * (1 - X.trapezoid(F.col("time"), 7.0, 1.3, 0.2, 1.0, 0.6)), 6).alias("flux"))


@query(f"""WITH {E}, g AS (SELECT target_id, coalesce(kind, 'all') AS kind, count(*) AS n, grouping(kind) AS every FROM (SELECT target_id % 10 AS target_id, kind FROM e) GROUP BY GROUPING SETS ((target_id, kind), (target_id)))
SELECT target_id, kind, n::BIGINT AS n, every::INT AS every FROM g""")
def counts_by_kind_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_series(spark, sf_dir).withColumn("target_id", F.col("target_id") % 10)
    out = e.groupingSets([[F.col("target_id"), F.col("kind")], [F.col("target_id")]], "target_id", "kind").agg(F.count("*").alias("n"), F.grouping("kind").cast("int").alias("every"))
    return out.select("target_id", F.coalesce("kind", F.lit("all")).alias("kind"), "n", "every")


@query(f"""WITH {E}, d AS (SELECT *, coalesce((time - lag(time) OVER (PARTITION BY target_id ORDER BY time) > 1.0)::INT, 0) AS b FROM e), g AS (SELECT *, sum(b) OVER (PARTITION BY target_id ORDER BY time) AS segment FROM d)
SELECT target_id, segment::BIGINT AS segment, count(*)::BIGINT AS n, round(max(time) - min(time), 6) AS length FROM g GROUP BY 1, 2""")
def segment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.segments(S.finite(event_series(spark, sf_dir)), 1.0)
    return g.groupBy("target_id", "segment").agg(F.count("*").alias("n"), F.round(F.max("time") - F.min("time"), 6).alias("length"))


@query(f"""WITH {TAKEN}, d AS (SELECT target_id, time, lead(time) OVER (PARTITION BY target_id ORDER BY time) AS after FROM f),
y AS (SELECT target_id, quantile_cont(after - time, 0.5) AS c, min(time) AS a, max(time) AS b FROM d GROUP BY 1), o AS (SELECT d.* FROM d JOIN y ON y.target_id = d.target_id WHERE after - time > 4 * c)
SELECT t.target_id, rank, round(time, 6) AS time, time - 1.5::DOUBLE * duration < a OR time + 1.5::DOUBLE * duration > b
OR EXISTS (SELECT 1 FROM o WHERE o.target_id = t.target_id AND o.time < t.time + 1.5::DOUBLE * t.duration AND o.after > t.time - 1.5::DOUBLE * t.duration) AS near_gap FROM t JOIN y ON y.target_id = t.target_id""")
def single_near_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = single.near_gaps(_events(spark, sf_dir), _series(spark, sf_dir))
    return _rounded(out.select("target_id", "rank", "time", "near_gap"), "time")


@query()
def single_minimum_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grid period of every event against every sample; the test holds the operator against brute force."""
    return single.scanned_events(_searched(spark, sf_dir), DURATIONS, 1.0, limits=dips.Rules(coverage=0.0))


STAR = """s AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_acctbal > 0 THEN c_acctbal::DOUBLE END AS t, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 50 > 0 THEN c_custkey % 50 / 10.0::DOUBLE END AS d,
CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 / 2.0::DOUBLE END AS m, CASE WHEN c_nationkey > 0 THEN c_nationkey / 10.0::DOUBLE END AS r, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 + 1.5::DOUBLE END AS g FROM customer)"""


@query(f"""WITH {STAR}, k AS (SELECT c_custkey, t, coalesce(d, m * {X.SUN_DENSITY} / (r * r * r), 3 * pow(10.0::DOUBLE, g) / (r * (4 * pi() * {X.G}::DOUBLE * {X.SUN_RADIUS}::DOUBLE))) AS d FROM s)
SELECT c_custkey, round(coalesce(t, {X.SUN_TEMPERATURE} * pow(pow(d / {X.SUN_DENSITY}, -1 / 2.1::DOUBLE), 0.4)), 4) AS temperature, round(coalesce(d, {X.SUN_DENSITY} * pow(pow(t / {X.SUN_TEMPERATURE}, 2.5), -2.1)) / (1 + coalesce(d, {X.SUN_DENSITY} * pow(pow(t / {X.SUN_TEMPERATURE}, 2.5), -2.1))), 6) AS density FROM k""")
def star_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for stars of which some values are known; densities are brought below 1."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumns({
        "t": F.when(k % 3 != 0, F.col("c_acctbal").cast("double")), "d": F.when(k % 2 == 0, (k % 50) / 10.0),
        "m": (k % 5) / 2.0, "r": F.col("c_nationkey") / 10.0, "g": F.when(k % 4 > 0, k % 4 + 1.5),
    })
    temperature, density = X.star_parameters(*[F.col(x) for x in "tdmrg"])
    return c.select("c_custkey", F.round(temperature, 4).alias("temperature"), F.round(density / (1 + density), 6).alias("density"))
