"""Queries over catalogues, scored rows and fixed-length views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import catalog as C
from tidewatch.operators import evaluate as V
from tidewatch.operators import ranking
from tidewatch.plans.catalogue import query
from tidewatch.sources.tables import table

#: Labelled rows with a score from 0 to 1 that follows the length of a document, ties included.
R = "r AS (SELECT d.doc_id, quality AS label, floor(least(n_chars, 4999) / 50) / 100 AS score, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"
K = R + ", e AS (SELECT score, sum(label) AS p, count(*) AS n FROM r GROUP BY 1), s AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k FROM e)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = F.floor(F.least("n_chars", F.lit(4999)) / 50) / 100
    return d.join(l, "doc_id").select("doc_id", F.col("quality").alias("label"), score.alias("score"), "source")


@query(f"WITH {K} SELECT round(sum(p::DOUBLE * tp / k) / sum(p), 6) AS ap FROM s")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.average_precision(scored(spark, sf_dir)).select(F.round("ap", 6).alias("ap"))


@query(f"WITH {R} SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END::DOUBLE) / count(*), 6) AS auc FROM r a, r b WHERE a.label = 1 AND b.label = 0")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.roc_auc(scored(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {R}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS i FROM r) SELECT k::INT AS k, round(avg(label::DOUBLE), 6) AS precision FROM o, (SELECT unnest([10, 20, 50]) AS k) WHERE i <= k GROUP BY 1")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.precision_at(scored(spark, sf_dir), [10, 20, 50], "doc_id").select("k", F.round("precision", 6).alias("precision"))


@query(f"""WITH {R}, c AS (SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score >= 0.4 AND label = 0) AS fp, count(*) FILTER (score < 0.4 AND label = 1) AS fn, count(*) FILTER (score < 0.4 AND label = 0) AS tn FROM r)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.confusion(scored(spark, sf_dir), 0.4).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {K}, b AS (SELECT *, tp / k AS plain, (tp / k + 1.0::DOUBLE / (2 * k) - sqrt(tp / k * (1 - tp / k) / k + 1.0::DOUBLE / (4 * k * k))) / (1 + 1.0::DOUBLE / k) AS bound FROM s),
o AS (SELECT *, CASE WHEN bound >= 0.9 THEN 0 WHEN plain >= 0.9 THEN 1 WHEN k >= 5 THEN 2 END AS kind FROM b)
SELECT score AS threshold, k::BIGINT AS k, kind::INT AS kind FROM o WHERE kind IS NOT NULL ORDER BY kind, CASE WHEN kind = 2 THEN -round(plain, 9) ELSE -k END, k, score LIMIT 1""")
def wilson_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.wilson_threshold(scored(spark, sf_dir), 0.9)


G = R + ", g AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, sum(label) AS positives, avg(score) AS mean_p, avg(label::DOUBLE) AS rate FROM r GROUP BY 1)"


@query(f"WITH {G} SELECT i.i::INT AS bin, coalesce(n, 0)::BIGINT AS n, coalesce(positives, 0)::BIGINT AS positives, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM range(10) i(i) LEFT JOIN g ON g.bin = i.i")
def reliability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reliability(scored(spark, sf_dir), 10).withColumns({c: F.round(c, 6) for c in ("mean_p", "rate")})


@query(f"""WITH {G}, q AS (SELECT score, label, greatest(1e-15, least(1 - 1e-15, score)) AS p FROM r)
SELECT (SELECT count(*) FROM r)::BIGINT AS n, (SELECT round(avg((score - label) ** 2), 6) FROM q) AS brier, (SELECT round(-avg(label * ln(p) + (1 - label) * ln(1 - p)), 6) FROM q) AS log_loss, (SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) FROM g) AS ece""")
def brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.calibration(scored(spark, sf_dir), 10).withColumns({c: F.round(c, 6) for c in ("brier", "log_loss", "ece")})


@query(f"""WITH {R} SELECT doc_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + ln(0.01 / 0.99) - ln(0.5 / 0.5)))), 6) AS p, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT *, greatest(score, 0.005) AS p FROM r) ORDER BY rank LIMIT 100""")
def rank_with_prior_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scored(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(100)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    return top.select("doc_id", F.round(V.prior_shift(F.greatest("score", F.lit(0.005)), 0.5, 0.01), 6).alias("p"), rank.alias("rank"))


@query(f"WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 10007, doc_id) AS k FROM r) SELECT doc_id, source FROM k WHERE k <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratified_sample(scored(spark, sf_dir), "source", F.struct(F.pmod(F.col("doc_id") * 7919, F.lit(10007)), "doc_id"), 5).select("doc_id", "source")


@query(f"WITH {R} SELECT source, label, count(*)::BIGINT AS n, sum((score >= 0.4)::INT)::BIGINT AS flagged, round(avg((score >= 0.4)::INT::DOUBLE), 6) AS rate FROM r GROUP BY GROUPING SETS ((), (source), (label), (source, label))")
def pass_rates_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = (F.col("score") >= 0.4).cast("int")
    out = scored(spark, sf_dir).cube("source", "label").agg(F.count("*").alias("n"), F.sum(flag).alias("flagged"), F.round(F.avg(flag.cast("double")), 6).alias("rate"))
    return out.select("source", "label", "n", "flagged", "rate")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label, o_totalprice FROM orders),
s AS (SELECT o_custkey, CASE WHEN max(label) = 1 THEN 1 WHEN min(label) = 0 AND count(label) = count(*) THEN 0 END AS star_label, count(*) AS n_rows FROM l GROUP BY 1),
b AS (SELECT l.o_custkey, o_orderkey, row_number() OVER (PARTITION BY l.o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM l JOIN s ON s.o_custkey = l.o_custkey AND s.star_label IS NOT DISTINCT FROM l.label)
SELECT s.o_custkey, star_label, n_rows::BIGINT AS n_rows, o_orderkey AS reference FROM s LEFT JOIN b ON b.o_custkey = s.o_custkey AND k = 1""")
def star_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("label", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0))
    return C.star_labels(rows, "o_custkey", "label", "o_totalprice", "o_orderkey")


@query("""SELECT o.o_orderkey, o.o_totalprice, min(p_partkey) AS p_partkey, count(*)::BIGINT AS n_matches FROM (SELECT o_orderkey, o_totalprice / 100 AS o_totalprice FROM orders) o JOIN part p ON abs(p_retailprice / o_totalprice - 1) < 0.0002 GROUP BY 1, 2""")
def archive_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, in hundreds, that cost what a part does."""
    left = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("o_totalprice"))
    return C.nearest_ratio(left, table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "o_totalprice", "p_retailprice", 0.0002, "p_partkey")


@query("""SELECT l_orderkey, l_linenumber, c_name, CASE WHEN o_orderkey IS NULL THEN 'none' WHEN o_orderstatus = 'F' THEN 'PC' ELSE 'AFP' END AS class
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT' LEFT JOIN customer ON c_custkey = o_custkey""")
def event_object_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_orderkey", "l_orderkey").withColumn("known", F.lit(True))
    out = C.unique_left_join(table(spark, sf_dir, "lineitem"), objects, ["l_orderkey"]).join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left")
    kind = F.when(F.col("known").isNull(), "none").when(F.col("o_orderstatus") == "F", "PC").otherwise("AFP")
    return out.select("l_orderkey", "l_linenumber", "c_name", kind.alias("class"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exclude_hosts_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def observed_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT o_orderkey, o_totalprice / c_acctbal AS ratio, list_bool_or(list_transform([1.0, 0.5, 2.0, 3.0, 1 / 3]::DOUBLE[], lambda a: abs(o_totalprice / c_acctbal / 10 - a) < 0.03 * a)) AS recovered FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0""")
def period_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).filter("c_acctbal > 0")
    return j.select("o_orderkey", (F.col("o_totalprice") / F.col("c_acctbal")).alias("ratio"), C.period_recovered(F.col("o_totalprice") / F.col("c_acctbal") / 10, F.lit(1.0)).alias("recovered"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_meta_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def cache_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("key", F.struct("user_id", "event_type"))
    return C.latest(rows, "key", "event_id").select("event_id", "user_id", "event_type", "value")


@query("SELECT doc_id FROM documents WHERE n_chars > 500 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM documents WHERE n_chars > 500")
def exclusions_and_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "documents").filter("n_chars > 500").select("doc_id")
    l = table(spark, sf_dir, "labels")
    return long.exceptAll(l.filter("toxic = 1").select("doc_id")).union(l.filter("quality = 0").select("doc_id").intersect(long))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'off target' WHEN regexp_matches(text, '(?i)token|password') THEN 'on target' ELSE 'not stated' END AS reason FROM documents""")
def reason_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(t.rlike("(?i)licen[sc]e"), "off target").when(t.rlike("(?i)token|password"), "on target").otherwise("not stated").alias("reason"))


@query("""WITH p AS (SELECT vec_id, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, round(sum(f::DOUBLE), 5) AS total, round(sum(f::DOUBLE * (i % 8)), 5) AS first_column, round(sum(f::DOUBLE * (i // 8)), 5) AS first_row FROM p GROUP BY 1""")
def image_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 as images of 8 by 8: flux and its first moments, without leaving the row."""
    def total(weight: str):
        return F.round(F.expr(f"aggregate(transform(embedding, (f, i) -> cast(f AS double) * {weight}), 0D, (a, x) -> a + x)"), 5)

    return table(spark, sf_dir, "embeddings").select("vec_id", total("1").alias("total"), total("(i % 8)").alias("first_column"), total("(i div 8)").alias("first_row"))


@query("""SELECT vec_id, b.b::INT AS block, round(list_avg(list_transform(embedding[b.b * 8 + 1 : b.b * 8 + 8], lambda x: greatest(-0.2, least(0.2, x::DOUBLE)))), 6) AS mean FROM embeddings, range(8) b(b)""")
def view_block_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views clipped and averaged over blocks of 8."""
    blocks = F.expr("transform(sequence(0, 7), b -> aggregate(slice(embedding, b * 8 + 1, 8), 0D, (a, x) -> a + greatest(-0.2D, least(0.2D, cast(x AS double))), a -> a / 8))")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(blocks).alias("block", "mean")).select("vec_id", "block", F.round("mean", 6).alias("mean"))


@query("""SELECT c_custkey, c_acctbal, min(s_suppkey) AS s_suppkey, count(*)::BIGINT AS n_matches FROM customer JOIN supplier ON c_acctbal > 0 AND s_acctbal > 0 AND abs(s_acctbal / c_acctbal - 1) < 0.01 GROUP BY 1, 2""")
def nearest_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return C.nearest_ratio(left, table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "c_acctbal", "s_acctbal", 0.01, "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exclude_urgent_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


EDGES = [0.0, 10.0, 20.0, 30.0, 60.0]


@query(f"""WITH x AS (SELECT l_quantity AS q, (l_discount >= 0.05)::INT AS predicted, l_tax >= 0.03 AS seen FROM lineitem WHERE l_returnflag = 'R'), e AS (SELECT b.b::INT AS bin, {EDGES}::DOUBLE[] AS e FROM range({len(EDGES) - 1}) b(b))
SELECT bin, e[bin + 1] AS low, e[bin + 2] AS high, count(q)::BIGINT AS n, round(avg(predicted), 6) AS recall, round(avg(seen::INT), 6) AS recovery, round(avg(predicted) FILTER (seen), 6) AS recall_of_recovered
FROM e LEFT JOIN x ON q >= e[bin + 1] AND q < e[bin + 2] GROUP BY 1, 2, 3""")
def recall_by_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") >= 0.05).cast("int").alias("predicted"), (F.col("l_tax") >= 0.03).cast("int").alias("recovered"), F.col("l_quantity").cast("double").alias("q"))
    out = V.recall_by(x, "q", EDGES)
    return out.select("bin", "low", "high", "n", *[F.round(c, 6).alias(c) for c in ("recall", "recovery", "recall_of_recovered")])


DRAWN = f"""{R}, i AS (SELECT d.doc_id, quality AS label, floor(least(n_chars, 4999) / 50) / 100 AS score, n_chars % 97 / 97.0::DOUBLE AS other FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
h AS (SELECT i.*, b.b AS resample, ('0x' || substr(md5('0:' || b.b || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM i, range(30) b(b)),
w AS (SELECT *, len(list_filter({V._POISSON}::DOUBLE[], lambda c: u >= c)) AS weight FROM h WHERE u >= 0.36787944)"""
AP = "SELECT resample, sum(p::DOUBLE * tp / k) / sum(p) AS ap, sum(p) AS p FROM (SELECT resample, p, sum(p) OVER (PARTITION BY resample ORDER BY {0} DESC) AS tp, sum(n) OVER (PARTITION BY resample ORDER BY {0} DESC) AS k FROM (SELECT resample, {0}, sum(label * weight) AS p, sum(weight) AS n FROM w GROUP BY 1, 2)) GROUP BY 1"


@query(f"WITH {DRAWN}, a AS ({AP.format('score')}) SELECT round(quantile_cont(ap, 0.16), 6) AS low, round(quantile_cont(ap, 0.84), 6) AS high, count(*)::BIGINT AS n FROM a WHERE p >= 2")
def precision_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.bootstrap_interval(scored(spark, sf_dir).select("doc_id", "label", "score"), 30, "doc_id")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query(f"""WITH {DRAWN}, a AS ({AP.format('score')}), b AS ({AP.format('other')}), d AS (SELECT a.ap - b.ap AS d FROM a JOIN b ON b.resample = a.resample)
SELECT round(avg((d > 0)::INT), 6) AS win_rate, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(d)::BIGINT AS n FROM d""")
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(l, "doc_id").select("doc_id", F.col("quality").alias("label"), (F.floor(F.least("n_chars", F.lit(4999)) / 50) / 100).alias("score"), (F.col("n_chars") % 97 / F.lit(97.0)).alias("other"))
    return V.win_rate(rows, "other", 30, "doc_id").select(*[F.round(c, 6).alias(c) for c in ("win_rate", "low", "high")], "n")


@query(f"WITH {K} SELECT score::DOUBLE AS score, round(tp / k, 6) AS precision, round(tp / sum(p) OVER (), 6) AS recall FROM s")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.precision_recall(scored(spark, sf_dir)).select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {K} SELECT max(score)::DOUBLE AS threshold FROM s WHERE tp >= (SELECT greatest(1, ceil(0.9::DOUBLE * sum(label))) FROM r)")
def threshold_for_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.threshold_for_recall(scored(spark, sf_dir), 0.9)


@query(f"""WITH {R}, q AS (SELECT source, avg((score >= 0.4)::INT::DOUBLE) AS rate FROM r GROUP BY 1), c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
SELECT round(sum(rate * n), 6) AS passing, round(coalesce(sum(rate * n) FILTER (q.source < 'src2'), 0) / sum(rate * n), 6) AS precision FROM q JOIN c ON c.source = q.source""")
def reweighted_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the labelled documents, weighted by how many documents a source has."""
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    out = V.reweighted_precision(scored(spark, sf_dir), counts, "source", F.col("source") < "src2", 0.4)
    return out.select(F.round("passing", 6).alias("passing"), F.round("precision", 6).alias("precision"))


OTHERS = "r AS (SELECT d.doc_id, quality AS label, floor(least(n_chars, 4999) / 50) / 100 AS score, n_chars % 97 / 97.0::DOUBLE AS other, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 97 / 97.0).alias("other"))
    return scored(spark, sf_dir).join(d, "doc_id")


@query(f"""WITH {OTHERS}, x AS (SELECT lang, label, 'score' AS ranker, score FROM r UNION ALL SELECT lang, label, 'other', other FROM r), y AS (SELECT * FROM x UNION ALL SELECT NULL, label, ranker, score FROM x),
e AS (SELECT lang, ranker, score, sum(label) AS p, count(*) AS n FROM y GROUP BY 1, 2, 3), t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM e WINDOW w AS (PARTITION BY lang, ranker ORDER BY score DESC))
SELECT lang, ranker, sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, round(sum(p)::DOUBLE / sum(n), 6) AS chance, round(sum(p::DOUBLE * tp / k) / nullif(sum(p), 0), 6) AS ap,
round((sum(p)::DOUBLE * (sum(n) - sum(p)) - sum(p * (k - tp - (n - p) / 2.0::DOUBLE))) / nullif(sum(p)::DOUBLE * (sum(n) - sum(p)), 0), 6) AS auc,
coalesce(sum(n) FILTER (score >= 0.4), 0)::BIGINT AS passing, round(sum(p)  FILTER (score >= 0.4) / sum(n) FILTER (score >= 0.4), 6) AS pass_precision FROM t GROUP BY 1, 2""")
def rankers_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.compare_rankers(_two_scores(spark, sf_dir), ["score", "other"], "lang", {"score": 0.4, "other": 0.4})
    return out.withColumns({c: F.round(c, 6) for c in ("chance", "ap", "auc", "pass_precision")})


@query(f"""WITH {OTHERS}, x AS (SELECT label, 'score' AS forecast, score AS p FROM r UNION ALL SELECT label, 'other', other FROM r UNION ALL SELECT label, 'rate', 0.5 FROM r), y AS (SELECT *, greatest(1e-15, least(1 - 1e-15, p)) AS q, least(floor(p * 10), 9) AS b FROM x),
g AS (SELECT forecast, b, count(*) AS n, sum((p - label) ** 2) AS s, sum(-(label * ln(q) + (1 - label) * ln(1 - q))) AS l, sum(p) AS e, sum(label) AS o FROM y GROUP BY 1, 2)
SELECT forecast, sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS log_loss, round(sum(abs(e - o)) / sum(n), 6) AS ece, round(sum(e), 4) AS expected, sum(o)::BIGINT AS observed FROM g GROUP BY 1""")
def forecasts_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_scores(spark, sf_dir)
    out = V.forecast_scores(rows, {"score": F.col("score"), "other": F.col("other"), "rate": F.lit(0.5)}, 10, "doc_id")
    return out.withColumns({c: F.round(c, 6) for c in ("brier", "log_loss", "ece")}).withColumn("expected", F.round("expected", 4))


@query(f"""WITH {OTHERS}, x AS (SELECT doc_id % 50 AS unit, 'score' AS forecast, (score - label) ** 2 AS s FROM r UNION ALL SELECT doc_id % 50, 'other', (other - label) ** 2 FROM r), u AS (SELECT forecast, unit, sum(s) AS s, count(*) AS n FROM x GROUP BY 1, 2),
h AS (SELECT u.*, b.b AS resample, ('0x' || substr(md5('0:' || b.b || ':' || unit), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS d FROM u, range(40) b(b)), w AS (SELECT *, len(list_filter({V._POISSON}::DOUBLE[], lambda c: d >= c)) AS w FROM h),
k AS (SELECT forecast, resample, sum(s * w) / sum(n * w) AS b FROM w WHERE w > 0 GROUP BY 1, 2) SELECT forecast, round(quantile_cont(b, 0.16), 6) AS low, round(quantile_cont(b, 0.84), 6) AS high FROM k GROUP BY 1""")
def brier_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_scores(spark, sf_dir).withColumn("star", F.col("doc_id") % 50)
    return V.brier_intervals(rows, {"score": F.col("score"), "other": F.col("other")}, "star", 40).select("forecast", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {OTHERS}, x AS (SELECT label, score * 6 - 2 AS raw FROM r) SELECT round(1 / (1 + exp(-(ln(0.7 / 0.3) - 0.2) / 1.5)), 6) AS threshold, count(*) FILTER (raw >= (ln(0.7 / 0.3) - 0.2) / 1.5)::BIGINT AS kept,
round(avg(label) FILTER (raw >= (ln(0.7 / 0.3) - 0.2) / 1.5), 6) AS precision, round(coalesce(sum(label) FILTER (raw >= (ln(0.7 / 0.3) - 0.2) / 1.5), 0) / sum(label), 6) AS recall FROM x""")
def probability_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _two_scores(spark, sf_dir).withColumn("raw", F.col("score") * 6 - 2)
    return V.probability_threshold(rows, 1.5, 0.2, 0.7).withColumns({c: F.round(c, 6) for c in ("threshold", "precision", "recall")})


@query("""WITH a AS (SELECT DISTINCT o_custkey AS c, month(o_orderdate) AS m FROM orders), t AS (SELECT c_custkey AS c, [c_custkey % 12 + 1, c_custkey % 5 + 3, 1] AS l FROM customer), w AS (SELECT c, unnest(l) AS m, unnest(range(1, 4)) AS place FROM t),
b AS (SELECT w.c, arg_min(w.m, place) AS m, min(place) AS place FROM w JOIN a ON a.c = w.c AND a.m = w.m GROUP BY 1) SELECT t.c AS c_custkey, b.m::INT AS month, b.place::INT AS place FROM t LEFT JOIN b ON b.c = t.c""")
def first_month_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for targets with a list of sectors, months with orders for the sectors that have data."""
    k = F.col("c_custkey")
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.array((k % 12 + 1).cast("int"), (k % 5 + 3).cast("int"), F.lit(1)).alias("months"))
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.month("o_orderdate").alias("month"))
    return C.first_available(wanted, there, "c_custkey", "months", "month").select("c_custkey", "month", "place")


@query("""WITH l AS (SELECT o_orderkey, o_custkey, o_totalprice::DOUBLE AS a FROM orders WHERE o_orderkey % 2 = 1), r AS (SELECT o_custkey, o_totalprice::DOUBLE AS published, min(o_orderkey) AS other FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
j AS (SELECT l.*, published, other, row_number() OVER (PARTITION BY l.o_orderkey ORDER BY abs(published - a), published) AS k FROM l LEFT JOIN r ON r.o_custkey = l.o_custkey)
SELECT o_orderkey, other::BIGINT AS other, round(published, 2) AS published, round((a - published) / sqrt(CASE WHEN published > a THEN 0.04 * a * a ELSE 0.01 * a * a END + 1), 6) AS errors FROM j WHERE k = 1""")
def compared_with_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd orders stand for fits, even ones of the same customer for published values: the nearest, and how far off it is."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("a"))
    published = o.filter("o_orderkey % 2 = 0").select("o_custkey", F.col("a").alias("published"), F.col("o_orderkey").alias("other"))
    out = C.nearest_of_key(o.filter("o_orderkey % 2 = 1"), published, "o_custkey", "a", "published", "other")
    errors = C.difference_in_errors(F.col("a"), 0.1 * F.col("a"), 0.2 * F.col("a"), F.col("published"), F.lit(1.0))
    return out.select("o_orderkey", "other", F.round("published", 2).alias("published"), F.round(errors, 6).alias("errors"))


@query(f"""WITH {R}, n AS (SELECT count(*) AS n FROM r), z AS (SELECT 25 * (1 << i) AS size, d::INT AS draw FROM range(20) a(i), range(3) b(d), n WHERE 25 * (1 << i) < n UNION ALL SELECT n, 0 FROM n)
SELECT size::BIGINT AS size, draw, count(*)::BIGINT AS n_stars, count(*)::BIGINT AS n, sum(label)::BIGINT AS positives FROM r, n, z WHERE ('0x' || substr(md5('7:' || draw || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < size / n::DOUBLE GROUP BY ALL""")
def learning_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random subsets of labelled rows, of sizes that double; smaller ones of a draw lie in its larger ones."""
    return ranking.subset_counts(scored(spark, sf_dir), 25, 3, seed=7, star="doc_id")


TRAINING = """WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_totalprice < 450000 THEN 0 END AS label, o_totalprice FROM orders),
s AS (SELECT o_custkey, CASE WHEN max(label) = 1 THEN 1 WHEN min(label) = 0 AND count(label) = count(*) THEN 0 END AS star_label, count(*) AS n_rows FROM l GROUP BY 1),
b AS (SELECT l.o_custkey, o_orderkey, row_number() OVER (PARTITION BY l.o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM l JOIN s ON s.o_custkey = l.o_custkey AND s.star_label IS NOT DISTINCT FROM l.label),
t AS (SELECT s.o_custkey, star_label, n_rows::BIGINT AS n_rows, o_orderkey AS reference, f.c_acctbal, f.c_nationkey, CASE WHEN x.c_custkey IS NOT NULL THEN 'excluded' WHEN star_label IS NULL THEN 'unlabelled' WHEN f.c_custkey IS NULL THEN 'unmeasured' ELSE 'used' END AS status
FROM s LEFT JOIN b ON b.o_custkey = s.o_custkey AND k = 1 LEFT JOIN customer x ON x.c_custkey = s.o_custkey AND x.c_mktsegment = 'BUILDING' LEFT JOIN customer f ON f.c_custkey = s.o_custkey AND f.c_acctbal > 0)"""


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_totalprice") < 450000, 0)
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    features = customers.filter("c_acctbal > 0").select("o_custkey", "c_acctbal", "c_nationkey")
    return C.training_set(table(spark, sf_dir, "orders").withColumn("label", label), features, customers.filter("c_mktsegment = 'BUILDING'"), "o_custkey", "label", "o_totalprice", "o_orderkey")


@query(f"{TRAINING} SELECT o_custkey, star_label, n_rows, reference, status, CASE WHEN status = 'used' THEN c_acctbal END AS c_acctbal, CASE WHEN status = 'used' THEN c_nationkey END AS c_nationkey FROM t")
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stars, orders as their candidates; those of a segment are what models are judged on."""
    return _training(spark, sf_dir)


@query(f"{TRAINING} SELECT status, count(*)::BIGINT AS n_stars, sum((star_label = 1)::INT)::BIGINT AS positives, sum(n_rows)::BIGINT AS n_rows FROM t GROUP BY 1")
def training_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the stars."""
    return _training(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_stars"), F.sum((F.col("star_label") == 1).cast("int")).alias("positives"), F.sum("n_rows").alias("n_rows"))
