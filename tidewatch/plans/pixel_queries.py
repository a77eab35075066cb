"""Queries over pixel cubes: vectors of the table `embeddings` stand for images, labels for stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import pixels
from tidewatch.plans.catalogue import query
from tidewatch.plans.fold_queries import _rounded
from tidewatch.sources.tables import table

BY = ["target_id", "sector"]
WIDTH, CENTRE, RADIUS = 8, 3.5, 3.0
P, T0, D = 4.0, 2.0, 1.0

FOLD = f"(time - {T0} + {P / 2}) - {P} * floor((time - {T0} + {P / 2}) / {P}) - {P / 2}"
SUMS = f"""w AS (SELECT vec_id, label % 4 AS target_id, vec_id % 2 AS sector, vec_id / 20.0 AS time, unnest(embedding)::DOUBLE + 10 * (1 - 0.05 * (abs({FOLD.replace('time', '(vec_id / 20.0)')}) < {D} / 2)::INT * (label % 4 % 2)) AS p, unnest(range(len(embedding))) AS i FROM embeddings),
m AS (SELECT vec_id, any_value(target_id) AS target_id, any_value(sector) AS sector, any_value(time) AS time, sum(p) AS s, sum(p * (i % {WIDTH})) AS sx, sum(p * (i // {WIDTH})) AS sy FROM w
  WHERE ((i % {WIDTH}) - {CENTRE}) ** 2 + ((i // {WIDTH}) - {CENTRE}) ** 2 <= {RADIUS**2} GROUP BY 1),
x AS (SELECT *, abs({FOLD}) AS away, round_even((time - {T0}) / {P}, 0) AS event FROM m),
e AS (SELECT target_id, sector, event, count(*) FILTER (away < 0.8 * {D} / 2) AS n_in, count(*) FILTER (away >= {D} AND away <= 2.5 * {D}) AS n_out,
  {', '.join(f'avg({c}) FILTER (away < 0.8 * {D} / 2) AS q{c}, avg({c}) FILTER (away >= {D} AND away <= 2.5 * {D}) AS o{c}' for c in ('s', 'sx', 'sy'))} FROM x GROUP BY 1, 2, 3),
v AS (SELECT target_id, sector, event, n_in, n_out, os - qs AS d, osx - qsx AS dx, osy - qsy AS dy, os AS o, osx AS ox, osy AS oy FROM e WHERE n_in > 0 AND n_out > 0)"""  # fmt: skip
TESTS = SUMS + """, a AS (SELECT target_id, sector, count(*) AS n_events, avg(d) AS md, avg(dx) AS mdx, avg(dy) AS mdy, avg(o) AS mo, avg(ox) AS mox, avg(oy) AS moy, stddev_samp(d) / sqrt(count(*)) AS err,
  CASE WHEN sum(CASE WHEN n_in > 1 THEN 1 / (n_in * n_in * (n_in - 1.0::DOUBLE)) ELSE 0 END + CASE WHEN n_out > 1 THEN 1 / (n_out * n_out * (n_out - 1.0::DOUBLE)) ELSE 0 END) > 0 THEN
    greatest(pow(sum(1 / n_in + 1 / n_out), 2) / sum(CASE WHEN n_in > 1 THEN 1 / (n_in * n_in * (n_in - 1.0::DOUBLE)) ELSE 0 END + CASE WHEN n_out > 1 THEN 1 / (n_out * n_out * (n_out - 1.0::DOUBLE)) ELSE 0 END) + 1, 3) ELSE 3 END AS units
  FROM v GROUP BY 1, 2),
u AS (SELECT a.*, (v.dx - mdx / md * v.d) / md - (v.ox - mox / mo * v.o) / mo AS ux, (v.dy - mdy / md * v.d) / md - (v.oy - moy / mo * v.o) / mo AS uy FROM v JOIN a ON a.target_id = v.target_id AND a.sector = v.sector WHERE md > 0 AND mo > 0),
c AS (SELECT target_id, sector, any_value(n_events) AS n_events, any_value(units) AS units, any_value(md / mo) AS depth, any_value(md / err) AS snr, any_value(mdx / md - mox / mo) AS dx, any_value(mdy / md - moy / mo) AS dy,
  sum(ux * ux) / (count(*) * (count(*) - 1.0)) AS xx, sum(ux * uy) / (count(*) * (count(*) - 1.0)) AS xy, sum(uy * uy) / (count(*) * (count(*) - 1.0)) AS yy FROM u GROUP BY 1, 2 HAVING count(*) > 2),
t AS (SELECT *, -(n_events - 2) / 2 * ln(1 + greatest((dx * dx * yy - 2 * dx * dy * xy + dy * dy * xx) / (xx * yy - xy * xy), 0) / (n_events - 1)) AS log_p, sqrt(dx * dx + dy * dy) AS distance FROM c)"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    time = F.col("vec_id") / 20.0
    rows = v.select((F.col("label") % 4).alias("target_id"), (F.col("vec_id") % 2).alias("sector"), time.alias("time"), *[F.lit(x).alias(c) for c, x in (("period", P), ("epoch", T0), ("duration", D))], "embedding")
    inside = F.abs(pixels.phase(F.col("time"), P, T0)) < D / 2
    light = 10 * (1 - F.when(inside, 0.05 * (F.col("target_id") % 2)).otherwise(0.0))
    cubes = rows.withColumn("pixels", F.transform("embedding", lambda p: p.cast("double") + light)).drop("embedding")
    return pixels.centroid_test(pixels.difference_events(pixels.image_sums(cubes, WIDTH, CENTRE, CENTRE, RADIUS), BY), BY)


@query(f"WITH {TESTS} SELECT target_id, sector, n_events::BIGINT AS n_events, round(units, 5) AS units, round(depth, 6) AS depth, round(snr, 5) AS snr, round(dx, 5) AS dx, round(dy, 5) AS dy, round(xx, 5) AS xx, round(xy, 5) AS xy, round(yy, 5) AS yy, round(log_p, 5) AS log_p FROM t")
def centroid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a dip put into every other label comes from, of cubes with three events or more whose difference image has light."""
    out = _tests(spark, sf_dir).filter("n_events > 2 AND x IS NOT NULL").select(*BY, "n_events", "units", "depth", "snr", "dx", "dy", "xx", "xy", "yy", "log_p")
    return _rounded(_rounded(out, "depth"), "units", "snr", "dx", "dy", "xx", "xy", "yy", "log_p", digits=5)


@query(f"""WITH {TESTS}, k AS (SELECT *, snr >= 3 AND distance <= 5 AS placed, xx * yy - xy * xy AS det, dx / sqrt(xx) AS ax, (dy - xy / xx * dx) / sqrt((xx * yy - xy * xy) / xx) AS ay FROM t),
g AS (SELECT target_id, count(*) AS n_cubes, count(*) FILTER (placed) AS n_placed, sqrt(sum(snr * snr)) AS snr, sum(yy / det) FILTER (placed) AS wxx, sum(-xy / det) FILTER (placed) AS wxy, sum(xx / det) FILTER (placed) AS wyy,
  sum((yy * dx - xy * dy) / det) FILTER (placed) AS bx, sum((xx * dy - xy * dx) / det) FILTER (placed) AS by_, sum(ax * sqrt(-2 * log_p) / sqrt(ax * ax + ay * ay)) FILTER (placed) AS zx, sum(ay * sqrt(-2 * log_p) / sqrt(ax * ax + ay * ay)) FILTER (placed) AS zy FROM k GROUP BY 1)
SELECT target_id, n_cubes::BIGINT AS n_cubes, n_placed::BIGINT AS n_placed, round(snr, 5) AS snr, round((wyy * bx - wxy * by_) / (wxx * wyy - wxy * wxy), 5) AS dx, round((wxx * by_ - wxy * bx) / (wxx * wyy - wxy * wxy), 5) AS dy, round(-(zx * zx + zy * zy) / (2 * n_placed), 5) AS log_p FROM g""")
def centroids_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _tests(spark, sf_dir).filter("n_events > 2 AND x IS NOT NULL")
    return _rounded(pixels.combined_tests(tests, ["target_id"]).select("target_id", "n_cubes", "n_placed", "snr", "dx", "dy", "log_p"), "snr", "dx", "dy", "log_p", digits=5)
