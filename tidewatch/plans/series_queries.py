"""Queries over series of samples; `events` are the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import series as S
from tidewatch.plans.catalogue import query
from tidewatch.sources.tables import event_series

#: SQL for the samples of event_series().
E = "e AS (SELECT user_id AS target_id, event_id AS sample_id, event_type AS kind, epoch_us(ts) / 86400000000.0::DOUBLE AS time, value AS flux FROM events)"
#: Normalised flux.
N = E + ", m AS (SELECT target_id, median(flux) AS m FROM e GROUP BY 1), f AS (SELECT e.target_id, sample_id, kind, time, flux / m AS flux FROM e JOIN m ON m.target_id = e.target_id WHERE m <> 0)"
GAP = 1.0


@query(f"""WITH {N}, c AS (SELECT target_id, median(flux) AS c FROM f GROUP BY 1),
s AS (SELECT f.target_id, count(*) AS n, any_value(c) AS c, median(abs(flux - c)) * 1.4826 AS s, max(abs(flux - c)) AS w FROM f JOIN c ON c.target_id = f.target_id GROUP BY 1),
g AS (SELECT target_id, count(*) FILTER (d > 1.0) + 1 AS g FROM (SELECT target_id, time - lag(time) OVER (PARTITION BY target_id ORDER BY time) AS d FROM f) GROUP BY 1)
SELECT s.target_id, n::BIGINT AS n_samples, g::BIGINT AS n_segments, round(s, 6) AS sigma, round(w / s, 6) AS deviation FROM s JOIN g ON g.target_id = s.target_id
WHERE s > 0 ORDER BY w / s DESC, s.target_id LIMIT 20""")
def top_deviant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 series whose largest deviation from the median is most robust sigmas."""
    f = S.normalised(S.finite(event_series(spark, sf_dir)))
    s = S.robust_scatter(f).filter("sigma > 0")
    g = S.segments(f, GAP).groupBy("target_id").agg((F.max("segment") + 1).alias("n_segments"))
    far = F.greatest(F.col("highest") - F.col("median"), F.col("median") - F.col("lowest"))
    out = s.withColumns({"w": far, "s": F.col("sigma")}).join(g, "target_id").orderBy(F.desc(F.col("w") / F.col("s")), "target_id").limit(20)
    return out.select("target_id", F.col("n").alias("n_samples"), "n_segments", F.round("s", 6).alias("sigma"), F.round(F.col("w") / F.col("s"), 6).alias("deviation"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finite(event_series(spark, sf_dir))


@query(f"WITH {N} SELECT sample_id, round(flux, 6) AS flux FROM f")
def series_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalised(_events(spark, sf_dir)).select("sample_id", F.round("flux", 6).alias("flux"))


@query(f"WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY target_id, time ORDER BY sample_id) AS k FROM (SELECT * REPLACE (floor(time * 4) / 4 AS time) FROM e)) SELECT sample_id, target_id, time FROM k WHERE k = 1")
def series_first_of_each_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to a quarter of a day, so that some repeat."""
    cut = _events(spark, sf_dir).withColumn("time", F.floor(F.col("time") * 4) / 4)
    return S.first_of_each_time(cut).select("sample_id", "target_id", "time")


@query(f"WITH {E}, d AS (SELECT *, coalesce((time - lag(time) OVER w > {GAP})::INT, 0) AS b FROM e WINDOW w AS (PARTITION BY target_id ORDER BY time)) SELECT sample_id, sum(b) OVER (PARTITION BY target_id ORDER BY time)::BIGINT AS segment FROM d")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segments(_events(spark, sf_dir), GAP).select("sample_id", "segment")


@query(f"WITH {N}, c AS (SELECT target_id, median(flux) AS c FROM f GROUP BY 1) SELECT f.target_id, count(*)::BIGINT AS n, round(median(abs(flux - c)) * 1.4826, 6) AS sigma FROM f JOIN c ON c.target_id = f.target_id GROUP BY 1")
def robust_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.robust_sigma(S.normalised(_events(spark, sf_dir))).select("target_id", "n", F.round("sigma", 6).alias("sigma"))


@query(f"""WITH {N}, c AS (SELECT target_id, median(flux) AS c, count(*) AS n FROM f GROUP BY 1), s AS (SELECT f.target_id, any_value(c) AS c, any_value(n) AS n, median(abs(flux - c)) * 1.4826 AS s FROM f JOIN c ON c.target_id = f.target_id GROUP BY 1)
SELECT f.target_id, any_value(n)::BIGINT AS n, count(*)::BIGINT AS kept, round(sqrt(avg(flux * flux)), 6) AS rms FROM f JOIN s ON s.target_id = f.target_id WHERE abs(flux - c) <= 2 * s GROUP BY 1""")
def robust_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.robust_rms(S.normalised(_events(spark, sf_dir)), clip=2.0).withColumn("rms", F.round("rms", 6))


@query(f"""WITH {N}, d AS (SELECT target_id, flux - lag(flux) OVER (PARTITION BY target_id ORDER BY time) AS d FROM f), c AS (SELECT target_id, median(d) AS c FROM d GROUP BY 1)
SELECT d.target_id, CASE WHEN count(d) >= 2 THEN round(median(abs(d - c)) * 1.4826 / sqrt(2), 6) END AS sigma FROM d JOIN c ON c.target_id = d.target_id WHERE d IS NOT NULL GROUP BY 1""")
def p2p_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.point_to_point_sigma(S.normalised(_events(spark, sf_dir))).select("target_id", F.round("sigma", 6).alias("sigma"))


@query(f"WITH {E}, d AS (SELECT target_id, time - lag(time) OVER (PARTITION BY target_id ORDER BY time) AS d FROM e) SELECT target_id, round(median(d), 6) AS cadence FROM d GROUP BY 1")
def median_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cadence(_events(spark, sf_dir)).select("target_id", F.round("cadence", 6).alias("cadence"))


@query(f"""WITH {E}, d AS (SELECT *, time - lag(time) OVER (PARTITION BY target_id ORDER BY time) AS d FROM e), o AS (SELECT target_id, min(time) AS t0, median(d) AS c FROM d GROUP BY 1)
SELECT e.target_id, floor((time - t0 + c / 2) / 2.0)::BIGINT AS bin, round(avg(time), 6) AS time, round(avg(flux), 6) AS flux, count(*)::BIGINT AS n FROM e JOIN o ON o.target_id = e.target_id WHERE c < 1.8 GROUP BY 1, 2, c HAVING count(*) >= 1.0 / c
UNION ALL SELECT e.target_id, row_number() OVER (PARTITION BY e.target_id ORDER BY time), round(time, 6), round(flux, 6), 1 FROM e JOIN o ON o.target_id = e.target_id WHERE c >= 1.8""")
def tumbling_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.binned(_events(spark, sf_dir), 2.0)
    return out.select("target_id", F.col("bin").cast("long").alias("bin"), F.round("time", 6).alias("time"), F.round("flux", 6).alias("flux"), "n")


@query(f"""WITH {E}, m AS (SELECT target_id, kind, median(flux) AS m FROM e GROUP BY 1, 2), j AS (SELECT e.*, flux / m AS g, row_number() OVER (PARTITION BY e.target_id, time ORDER BY e.kind) AS k FROM e JOIN m ON m.target_id = e.target_id AND m.kind = e.kind WHERE m <> 0)
SELECT target_id, count(*)::BIGINT AS n, round(avg(g), 6) AS mean, round(median(g), 6) AS median FROM j WHERE k = 1 GROUP BY 1""")
def stitched_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types are the parts of a series."""
    out = S.stitched(_events(spark, sf_dir), part="kind")
    return out.groupBy("target_id").agg(F.count("*").alias("n"), F.round(F.avg("flux"), 6).alias("mean"), F.round(F.median("flux"), 6).alias("median"))


@query(f"""WITH {E}, c AS (SELECT target_id, time, count(*) OVER (PARTITION BY target_id ORDER BY time RANGE BETWEEN CURRENT ROW AND 10.0::DOUBLE FOLLOWING) AS n FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY n DESC, time) AS k FROM c) SELECT target_id, round(time, 6) AS start, n::BIGINT AS n FROM k WHERE k = 1""")
def densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.densest_window(_events(spark, sf_dir), 10.0).select("target_id", F.round("start", 6).alias("start"), "n")


@query(f"""WITH {N}, c AS (SELECT target_id, median(flux) AS c FROM f GROUP BY 1), s AS (SELECT f.target_id, any_value(c) AS c, median(abs(flux - c)) * 1.4826 AS s FROM f JOIN c ON c.target_id = f.target_id GROUP BY 1)
SELECT sample_id, round(greatest(c - 1.5 * s, least(c + 1.5 * s, flux)), 6) AS flux FROM f JOIN s ON s.target_id = f.target_id""")
def winsorised_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.winsorised(S.normalised(_events(spark, sf_dir)), 1.5).select("sample_id", F.round("flux", 6).alias("flux"))


@query(f"""WITH {N}, d AS (SELECT *, coalesce((time - lag(time) OVER (PARTITION BY target_id ORDER BY time) > {GAP})::INT, 0) AS b FROM f), g AS (SELECT *, sum(b) OVER (PARTITION BY target_id ORDER BY time) AS segment FROM d)
SELECT sample_id, round(quantile_cont(flux, 0.5) OVER (PARTITION BY target_id, segment ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS trend FROM g""")
def running_median_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.running_median(S.segments(S.normalised(_events(spark, sf_dir)), GAP), 5)
    return out.select("sample_id", F.round("trend", 6).alias("trend"))


@query(f"WITH {E} SELECT target_id, count(*)::BIGINT AS n, round(min(time), 6) AS first, round(sum(flux), 4) AS total FROM e GROUP BY 1")
def packed_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.unpacked(S.packed(_events(spark, sf_dir)))
    return out.groupBy("target_id").agg(F.count("*").alias("n"), F.round(F.min("time"), 6).alias("first"), F.round(F.sum("flux"), 4).alias("total"))
