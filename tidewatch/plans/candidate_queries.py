"""Queries over ranked stars and their catalogued candidates: customers stand for stars, their orders for candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import candidates as K
from tidewatch.operators import evaluate as V
from tidewatch.operators import series as S
from tidewatch.plans.catalogue import query
from tidewatch.plans.fold_queries import _rounded
from tidewatch.sources.tables import event_series, table

TABLES = """cat AS (SELECT o_custkey AS star, o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'PC' WHEN 'P' THEN 'APC' ELSE 'FP' END AS disposition,
  CASE WHEN o_totalprice > 475000 THEN 1 WHEN o_totalprice > 20000 THEN 0 END AS label, o_totalprice / 1000 AS period, o_totalprice / 7 AS depth, (o_orderkey * 7919 % 1000) / 10.0::DOUBLE AS snr FROM orders),
sc AS (SELECT c_custkey AS star, floor((c_acctbal + 1000) / 110) / 100 AS score, (c_acctbal + 1000) / 100 AS found_period FROM customer),
known AS (SELECT star, concat('K', id) AS name, period FROM cat WHERE disposition = 'FP')"""
ALIAS = "list_bool_or(list_transform([1.0, 0.5, 2.0, 3.0, 1 / 3]::DOUBLE[], lambda a: abs(found_period / {0} - a) < 0.03 * a))"
RANKED = f"""{TABLES}, o AS (SELECT *, row_number() OVER (PARTITION BY star ORDER BY snr DESC, id) AS i FROM cat WHERE disposition <> 'FP'), ids AS (SELECT star, string_agg(id, ' ' ORDER BY id) AS candidates FROM o GROUP BY 1),
r AS (SELECT row_number() OVER (ORDER BY score DESC, o.star) AS rank, o.star, id AS reference, candidates, disposition, period, depth, snr, score, found_period, score >= 0.5 AS kept, {ALIAS.format('period')} AS period_recovered,
  (SELECT min(name) FROM known k WHERE k.star = o.star AND abs(k.period / o.period - 1) < 0.05) AS confirmed FROM o JOIN sc ON sc.star = o.star JOIN ids ON ids.star = o.star WHERE i = 1)"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("star"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "PC").when(F.col("o_orderstatus") == "P", "APC").otherwise("FP").alias("disposition"),
        F.when(price > 475000, 1).when(price > 20000, 0).alias("label"), (price / 1000).alias("period"), (price / 7).alias("depth"), (F.col("o_orderkey") * 7919 % 1000 / 10.0).alias("snr"),
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.col("c_acctbal") + 1000
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("star"), (F.floor(shifted / 110) / 100).alias("score"), (shifted / 100).alias("found_period"))


def _open(spark: SparkSession, sf_dir: str, ranked: bool = False) -> DataFrame:
    catalogue = _catalogue(spark, sf_dir)
    known = catalogue.filter("disposition = 'FP'").select("star", F.concat(F.lit("K"), F.col("id").cast("string")).alias("name"), "period")
    stars = K.of_stars(catalogue, "star", "snr", "id", ["period", "depth", "snr"])
    return (K.open_ranking if ranked else K.open_stars)(_scored(spark, sf_dir), stars, known, 0.5, "star", 0.05)


@query(f"WITH {RANKED} SELECT * REPLACE (round(depth, 6) AS depth, round(period, 6) AS period) FROM r")
def open_hosts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_open(spark, sf_dir, ranked=True), "depth", "period")


@query(f"WITH {RANKED} SELECT disposition, count(*)::BIGINT AS n, round(avg(kept::INT), 6) AS kept_share, round(median(score), 6) AS median FROM r GROUP BY 1")
def open_hosts_by_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.by_group(_open(spark, sf_dir), "disposition", "score"), "kept_share", "median")


@query(f"""WITH {RANKED}, b AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS low, unnest([0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS high)
SELECT low, high, (SELECT count(*) FROM r WHERE score >= low AND (score < high OR high = 1 AND score <= 1))::BIGINT AS n FROM b""")
def open_hosts_by_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counts_between(_open(spark, sf_dir), "score", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


@query(f"""WITH {RANKED}, x AS (UNPIVOT (SELECT period, depth, snr FROM r) ON period, depth, snr INTO NAME quantity VALUE v), y AS (UNPIVOT (SELECT period, depth, snr FROM cat WHERE disposition = 'FP') ON period, depth, snr INTO NAME quantity VALUE v),
a AS (SELECT quantity, median(v) AS m, count(*) AS n FROM x GROUP BY 1), b AS (SELECT quantity, median(v) AS m, count(*) AS n FROM y GROUP BY 1)
SELECT a.quantity, round(a.m, 6) AS open, a.n::BIGINT AS n_open, round(b.m, 6) AS resolved, b.n::BIGINT AS n_resolved FROM a JOIN b ON b.quantity = a.quantity""")
def open_and_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = _catalogue(spark, sf_dir).filter("disposition = 'FP'")
    return _rounded(K.medians_compared(_open(spark, sf_dir), resolved, ["period", "depth", "snr"]), "open", "resolved")


@query(f"""WITH {RANKED}, x AS (UNPIVOT (SELECT (confirmed IS NOT NULL)::INT AS y, score, snr, depth FROM r) ON score, snr, depth INTO NAME ranker VALUE v)
SELECT a.ranker, (SELECT count(*) FROM r WHERE confirmed IS NOT NULL)::BIGINT AS positives, round(sum(CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN 0.5 ELSE 0 END::DOUBLE) / count(*), 6) AS auc FROM x a, x b WHERE a.ranker = b.ranker AND a.y = 1 AND b.y = 0 GROUP BY 1""")
def confirmed_among_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the open stars that are confirmed elsewhere sit in several orderings."""
    rows = _open(spark, sf_dir).withColumn("label", F.col("confirmed").isNotNull().cast("int"))
    out = V.compare_rankers(rows, ["score", "snr", "depth"], "disposition").filter("disposition IS NULL")
    return _rounded(out.select("ranker", "positives", "auc"), "auc")


GROUPS = f"""{TABLES}, g AS (SELECT star, CASE WHEN max(label) = 1 THEN 'planet' WHEN min(label) = 0 AND count(label) = count(*) THEN 'false positive' ELSE 'open' END AS grp, list(period) AS ps FROM cat GROUP BY 1),
h AS (SELECT sc.*, coalesce(grp, 'not catalogued') AS "group", coalesce(list_bool_or(list_transform(ps, lambda p: {ALIAS.format('p')})), false) AS period_found, row_number() OVER (ORDER BY score DESC, sc.star) AS rank FROM sc LEFT JOIN g ON g.star = sc.star)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.host_groups(_scored(spark, sf_dir), _catalogue(spark, sf_dir), "star")


@query(f"""WITH {GROUPS} SELECT "group", count(*)::BIGINT AS n, round(avg((score >= 0.5)::INT), 6) AS flagged_share, median(rank)::DOUBLE AS median_rank, round(avg(period_found::INT) FILTER ("group" <> 'not catalogued'), 6) AS found_share,
round(avg((score >= 0.5)::INT) FILTER ("group" <> 'not catalogued' AND period_found), 6) AS flagged_of_found FROM h GROUP BY 1""")
def host_group_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.group_ranks(_groups(spark, sf_dir), F.col("score") >= 0.5, "star"), "flagged_share", "found_share", "flagged_of_found")


@query(f"""WITH {GROUPS}, p AS (SELECT 'planet' AS wanted, 'false positive' AS others UNION ALL SELECT 'planet', 'open' UNION ALL SELECT 'open', 'not catalogued'),
x AS (SELECT wanted, others, score, ("group" = wanted)::INT AS label FROM h JOIN p ON "group" = wanted OR "group" = others), e AS (SELECT wanted, others, score, sum(label) AS p, count(*) AS n FROM x GROUP BY 1, 2, 3),
t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM e WINDOW w AS (PARTITION BY wanted, others ORDER BY score DESC))
SELECT wanted, others, sum(n)::BIGINT AS n, round(sum(p)::DOUBLE / sum(n), 6) AS chance, round(sum(p::DOUBLE * tp / k) / sum(p), 6) AS ap FROM t GROUP BY 1, 2 HAVING sum(p) > 0 AND sum(p) < sum(n)""")
def host_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.contrasts(_groups(spark, sf_dir), [("planet", "false positive"), ("planet", "open"), ("open", "not catalogued")]), "chance", "ap")


@query("""WITH q AS (UNPIVOT (SELECT l_partkey AS part, l_quantity::DOUBLE AS quantity, l_discount * 1000 AS discount FROM lineitem) ON quantity, discount INTO NAME name VALUE v),
f AS (SELECT part, name, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.16) AS lo, quantile_cont(v, 0.84) AS hi FROM q GROUP BY 1, 2),
p AS (SELECT p_partkey AS part, 'quantity' AS name, p_size::DOUBLE AS published, NULL::DOUBLE AS e FROM part UNION ALL SELECT p_partkey, 'discount', p_retailprice / 20, 2.0 FROM part),
j AS (SELECT p.part, p.name, published, coalesce(e, 0) AS e, m, lo, hi, CASE WHEN published > m THEN hi - m ELSE m - lo END AS own FROM p LEFT JOIN f ON f.part = p.part AND f.name = p.name)
SELECT part, name AS quantity, round(m, 6) AS fitted, round(lo, 6) AS low, round(hi, 6) AS high, published, round((published - m) / nullif(sqrt(own * own + e * e), 0), 5) AS difference FROM j""")
def compared_with_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a part as draws of its quantity and discount, against what the table of parts says."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("quantity"), v.cast("double").alias("v")) for n, v in (("quantity", F.col("l_quantity")), ("discount", F.col("l_discount") * 1000))])).alias("x")
    draws = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), each).select("part", "x.*")
    published = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_size", (F.col("p_retailprice") / 20).alias("price"), F.lit(2.0).alias("price_error"))
    out = K.compared_with_published(K.interval(draws, "v", ["part", "quantity"]), published, "part", {"quantity": ("p_size", None), "discount": ("price", "price_error")})
    return _rounded(_rounded(out, "fitted", "low", "high"), "difference", digits=5)


VETOED = """t AS (SELECT vec_id, CASE WHEN label % 5 = 0 THEN 'weak' ELSE 'ok' END AS status, abs(embedding[1]::DOUBLE) * 30 AS sigma, abs(embedding[2]::DOUBLE) * 4 AS shift FROM embeddings),
v AS (SELECT d.doc_id, quality AS label, lang AS disposition, d.source AS reason, vec_id IS NOT NULL AS tested, status, sigma, shift, coalesce(status = 'ok' AND sigma >= 3 AND shift >= 0.2, false) AS flagged, floor(least(n_chars, 4999) / 50) / 100 AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN t ON vec_id = d.doc_id)"""


def _vetoed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 5 == 0, "weak").otherwise("ok").alias("status"), *[(F.abs(F.get("embedding", F.lit(i)).cast("double")) * x).alias(c) for i, x, c in ((0, 30, "sigma"), (1, 4, "shift"))])
    tests = e.withColumn("significant", (F.col("status") == "ok") & (F.col("sigma") >= 3) & (F.col("shift") >= 0.2))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("doc_id", F.col("quality").alias("label"), F.col("lang").alias("disposition"), F.col("source").alias("reason"), (F.floor(F.least("n_chars", F.lit(4999)) / 50) / 100).alias("score"))
    return K.vetoed(rows, tests, "doc_id")


@query(f"""WITH {VETOED}, g AS (SELECT CASE label WHEN 1 THEN 'planets' WHEN 0 THEN 'false positives' END AS "group", tested, flagged FROM v UNION ALL SELECT disposition, tested, flagged FROM v)
SELECT "group", count(*)::BIGINT AS n, sum(tested::INT)::BIGINT AS tested, sum(flagged::INT)::BIGINT AS flagged FROM g WHERE "group" IS NOT NULL GROUP BY 1""")
def veto_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.veto_counts(_vetoed(spark, sf_dir))


@query(f"""WITH {VETOED}, s AS (SELECT unnest([0.1, 0.25, 0.5, 1.0]::DOUBLE[]) AS s)
SELECT s AS shift, round(avg((status = 'ok' AND sigma >= 3 AND shift >= s)::INT) FILTER (label = 1 AND tested), 6) AS planets, round(avg((status = 'ok' AND sigma >= 3 AND shift >= s)::INT) FILTER (label = 0 AND tested), 6) AS false_positives FROM v, s GROUP BY 1""")
def veto_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.veto_floors(_vetoed(spark, sf_dir), 3.0), "planets", "false_positives")


@query(f"""WITH {VETOED}, x AS (SELECT label, 'score' AS ranker, score FROM v UNION ALL SELECT label, 'score_after', score - flagged::INT FROM v), e AS (SELECT ranker, score, sum(label) AS p, count(*) AS n FROM x GROUP BY 1, 2),
u AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM e WINDOW w AS (PARTITION BY ranker ORDER BY score DESC)) SELECT ranker, round(sum(p::DOUBLE * tp / k) / sum(p), 6) AS ap FROM u GROUP BY 1""")
def veto_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision before and after the veto ranks what it flags last."""
    out = V.compare_rankers(_vetoed(spark, sf_dir), ["score", "score_after"], "disposition").filter("disposition IS NULL")
    return _rounded(out.select("ranker", "ap"), "ap")


@query(f"""SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS star_teff, round(CASE WHEN c_nationkey > 0 THEN log10(c_nationkey) END, 6) AS star_log_density, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal / 5000) END, 6) AS star_log_radius,
round(CASE WHEN c_acctbal > 0 THEN log10(sqrt(o_totalprice / 1e6) * (c_acctbal / 5000) * {K.EARTHS_PER_SUN!r}::DOUBLE) END, 6) AS log_companion_radius FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def star_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("star"), F.log10(F.col("o_totalprice") / 1e6).alias("log_depth"))
    stars = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("star"), F.col("c_acctbal").alias("temperature"), F.col("c_nationkey").alias("density"), (F.col("c_acctbal") / 5000).alias("radius"))
    out = K.with_stars(features, stars, "star").select("o_orderkey", "star_teff", "star_log_density", "star_log_radius", "log_companion_radius")
    return _rounded(out, "star_log_density", "star_log_radius", "log_companion_radius")


@query()
def catalogued_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short views of every candidate of a star that has a series: a star's own candidates are masked together."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("candidate"), (F.col("o_totalprice") / 50000 + 2).alias("period"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000.0).alias("epoch"), (F.col("o_orderkey") % 12 * 4).alias("hours"))
    return K.candidate_views(S.dealt(S.finite(event_series(spark, sf_dir))), K.ephemerides(rows), "candidate", spacing=20.0, gap=5.0, least=32, global_bins=20, local_bins=5, bin_width=1.6)
