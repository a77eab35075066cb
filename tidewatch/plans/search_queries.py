"""Queries that detrend, search, describe and rank series, keep results, and follow streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import physics as X
from tidewatch.operators import boxsearch, detrend, dips, features, fold, ranking, store, survey, windowed
from tidewatch.operators import series as S
from tidewatch.plans.catalogue import query
from tidewatch.plans.fold_queries import DURATIONS, PERIODS, POWERS, D, P, T0, _rounded, _searched, _series
from tidewatch.plans.series_queries import E
from tidewatch.sources.tables import event_series, shared_dir
from tidewatch.streaming import series as live

BEST = POWERS + """, b1 AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(power, 9) DESC, period) AS rr FROM best),
sig AS (SELECT target_id, period, (start * 0.125 + k * 0.125 / 2)::DOUBLE AS epoch, (k * 0.125)::DOUBLE AS duration, depth FROM b1 WHERE rr = 1),
md AS (SELECT target_id, median(flux) AS c FROM f GROUP BY 1), sc AS (SELECT f.target_id, median(abs(flux - c)) * 1.4826 AS s FROM f JOIN md ON md.target_id = f.target_id GROUP BY 1),
r AS (SELECT f.target_id, flux, time, period, epoch, duration, depth, s, (time - epoch + period / 2) - period * floor((time - epoch + period / 2) / period) - period / 2 AS phase, round_even((time - epoch) / period, 0) AS ev FROM f JOIN sig ON sig.target_id = f.target_id JOIN sc ON sc.target_id = f.target_id),
ev AS (SELECT target_id, ev, count(*) AS c, sum(((flux - 1) ** 2 - (flux - 1 + depth) ** 2) / (s * s) / 2) AS g FROM r WHERE abs(phase) < duration / 2 GROUP BY 1, 2),
et AS (SELECT target_id, count(*) AS n_transits, min(c) AS least, sum(g) AS dll, max(abs(g)) / sum(abs(g)) AS share FROM ev GROUP BY 1),
mn AS (SELECT target_id, (avg(flux) FILTER (abs(phase) >= duration / 2) - avg(flux) FILTER (abs(phase) < duration / 2)) / (any_value(s) * sqrt(1 / count(*) FILTER (abs(phase) < duration / 2) + 1 / count(*) FILTER (abs(phase) >= duration / 2))) AS snr FROM r GROUP BY 1)"""


@query(f"""WITH {BEST} SELECT sig.target_id, sig.period, round(sig.epoch, 6) AS epoch, sig.duration, round(sig.depth, 6) AS depth, round(snr, 5) AS bls_depth_snr, round(sig.depth / s, 6) AS bls_depth_over_scatter, round(dll, 5) AS delta_loglike,
n_transits::BIGINT AS n_transits, least::BIGINT AS min_points_per_transit, round(share, 6) AS max_single_event_fraction, round(log10(s), 6) AS log_scatter, round(log10(greatest(sig.depth, 1e-8)), 6) AS log_depth
FROM sig JOIN sc ON sc.target_id = sig.target_id JOIN et ON et.target_id = sig.target_id JOIN mn ON mn.target_id = sig.target_id""")
def signal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that SQL can state shortly, of the best signal of every series."""
    f = _series(spark, sf_dir)
    out = features.searched(f, PERIODS, DURATIONS, floor=5)
    out = _rounded(out, "epoch", "depth", "bls_depth_over_scatter", "max_single_event_fraction", "log_scatter", "log_depth")
    out = _rounded(out, "bls_depth_snr", "delta_loglike", digits=5)
    return out.select("target_id", "period", "epoch", "duration", "depth", "bls_depth_snr", "bls_depth_over_scatter", "delta_loglike", "n_transits", "min_points_per_transit", "max_single_event_fraction", "log_scatter", "log_depth")


@query()
def full_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features; the test of the operator holds them against a brute-force version."""
    f = _searched(spark, sf_dir)
    return features.searched(f, PERIODS, DURATIONS, floor=5)


@query()
def flattened_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are sparse: knots 20 days apart, gaps of 5 days."""
    return detrend.flattened(S.dealt(S.finite(event_series(spark, sf_dir))), spacing=20.0, gap=5.0, least=32)


@query()
def flattened_around_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As flattened_series, and again with the events of a signal kept out of the fit, of half the efficiency asked of dense series."""
    return detrend.flattened_around_signal(S.dealt(S.finite(event_series(spark, sf_dir))), PERIODS, DURATIONS, spacing=20.0, gap=5.0, least=32, threshold=2.5, floor=5)


@query()
def periodogram_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detrend.dominant_period(_series(spark, sf_dir), 1.0, 20.0)


@query()
def signals_one_after_another(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.iterative_search(_searched(spark, sf_dir), PERIODS, DURATIONS, threshold=1.5, rounds=2, least=20, floor=5)


def _injected(spark: SparkSession, sf_dir: str, periods: list[float] | None = PERIODS, floor: int = 5) -> DataFrame:
    """Stored features of all series, every other one with dips put in (label 1). periods: None for each series' own grid."""
    has = F.col("target_id") % 2 == 0
    f = _searched(spark, sf_dir).withColumn("flux", F.when(has, F.col("flux") * (1 - X.trapezoid(F.col("time"), P, T0, 0.8, D, 0.8))).otherwise(F.col("flux")))
    rows = features.searched(f, periods, DURATIONS, floor=floor).withColumn("label", (F.col("target_id") % 2 == 0).cast("int"))
    rows.write.parquet(kept := f"{shared_dir(spark)}/ranked-features-{uuid.uuid4().hex}")
    return spark.read.schema(rows.schema).parquet(kept)


@query()
def injected_and_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dips are put into every other series; trees that did not see a series say whether it has one."""
    return ranking.trained_scores(_injected(spark, sf_dir), features.FEATURES, trees=10).select("target_id", "label", "fold", "raw", "score")


@query()
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the stars that are held out are ranked, by how many others the trees saw: signals of each series' own grid of 2,000
    periods or more, ten draws a size, 30 trees."""
    rows = ranking.by_star(_injected(spark, sf_dir, None, 10), 0.3, 5)
    return ranking.learning_curve(rows.filter("NOT held_out"), rows.filter("held_out"), features.FEATURES, start=20)


@query(f"WITH {E} SELECT target_id, count(*)::BIGINT AS n, round(avg(flux), 6) AS mean FROM e GROUP BY 1")
def computed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all series, where half the series are known from a run before."""
    f = S.finite(event_series(spark, sf_dir))
    means = lambda x: x.groupBy("target_id").agg(F.count("*").alias("n"), F.avg("flux").alias("mean"))
    known = store.update(f.filter("target_id % 2 = 0"), None, means, "1")
    return _rounded(store.update(f, known, means, "1").drop("fingerprint"), "mean")


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = live.stream_of(spark, sf_dir, "events.parquet", EVENTS)
    return raw.select(F.col("user_id").alias("target_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("flux"))


@query("SELECT user_id AS target_id, floor(epoch_us(ts) / 172800000000.0)::BIGINT AS bin, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def streamed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.drained(live.binned(_stream(spark, sf_dir), "2 days", "30 days"), spark, shared_dir(spark), final=True)
    return out.select("target_id", F.floor(F.unix_micros("start") / 172800000000.0).alias("bin"), "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {E}, d AS (SELECT *, coalesce((time - lag(time) OVER (PARTITION BY target_id ORDER BY time) >= 1.0)::INT, 0) AS b FROM e), g AS (SELECT *, sum(b) OVER (PARTITION BY target_id ORDER BY time) AS g FROM d)
SELECT target_id, round(min(time), 6) AS start, count(*)::BIGINT AS n, round(avg(flux), 6) AS mean FROM g GROUP BY target_id, g""")
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = live.drained(live.sessions(_stream(spark, sf_dir), "1 day", "30 days"), spark, shared_dir(spark), final=True)
    return out.select("target_id", F.round(F.unix_micros("start") / 86400000000.0, 6).alias("start"), "n", F.round("mean", 6).alias("mean"))


@query()
def windowed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dip every 5.3 days put into all series, found from the densest 15 of their 30 days and by pairs of dips; tests hold
    the operator against brute force and planted signals."""
    f = _searched(spark, sf_dir).withColumn("flux", F.col("flux") * (1 - X.trapezoid(F.col("time"), 5.3, T0, 0.8, D, 0.8)))
    return windowed.windowed_search(f, DURATIONS, 15.0, candidates=3, grid=np.geomspace(1.5, 7.5, 200), pairs=dips.Rules(threshold=2.0))


@query()
def flattened_with_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As flattened_series, with harmonics of a period between 1 and 10 days where they help."""
    return detrend.flattened(S.dealt(S.finite(event_series(spark, sf_dir))), spacing=20.0, gap=5.0, least=32, rotation=(1.0, 10.0))


LEAST = 60
STATUS = BEST + f""", c AS (SELECT user_id AS target_id, count(value) AS n_samples FROM events GROUP BY 1),
z AS (SELECT c.target_id, n_samples, CASE WHEN n_samples < {LEAST} THEN 'short' WHEN sig.target_id IS NULL THEN 'nothing' ELSE 'ok' END AS status, CASE WHEN n_samples >= {LEAST} THEN sig.period END AS period, CASE WHEN n_samples >= {LEAST} THEN sig.depth END AS depth
FROM c LEFT JOIN sig ON sig.target_id = c.target_id)"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda f: boxsearch.signals(S.normalised(f), PERIODS, DURATIONS, floor=5, errors=True).select("target_id", "period", "depth", "error")
    return survey.with_status(best, LEAST)(event_series(spark, sf_dir))


@query(f"WITH {STATUS} SELECT target_id, n_samples::BIGINT AS n_samples, status, period, round(depth, 6) AS depth FROM z")
def series_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_run(spark, sf_dir).select("target_id", "n_samples", "status", "period", "depth"), "depth")


@query(f"""WITH {STATUS} SELECT status, count(*)::BIGINT AS n, count(depth)::BIGINT AS n_scored, round(coalesce(sum(depth / (1 + depth)), 0), 5) AS expected, round(max(depth / (1 + depth)), 6) AS best FROM z GROUP BY ROLLUP (status)""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths, brought below 1, stand for probabilities."""
    rows = _run(spark, sf_dir).withColumn("p", F.col("depth") / (1 + F.col("depth")))
    return _rounded(_rounded(survey.summary(rows, "p"), "expected", digits=5), "best")
