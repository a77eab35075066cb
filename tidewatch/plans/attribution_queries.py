"""Queries over contributions to scores."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import attributions as A
from tidewatch.operators import ranking
from tidewatch.plans.catalogue import query
from tidewatch.sources.tables import table

PLACES = [f"x{i:02d}" for i in range(64)]
#: Components that are not zero, by their size, with their sign.
EACH = "p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query(f"""WITH {EACH}, d AS (SELECT *, unnest(['up', 'down', 'either']) AS direction FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, direction ORDER BY CASE direction WHEN 'up' THEN -c WHEN 'down' THEN c ELSE -abs(c) END, i) AS rank FROM d
  WHERE CASE direction WHEN 'up' THEN c > 0 WHEN 'down' THEN c < 0 ELSE c <> 0 END)
SELECT vec_id, direction, rank::INT AS rank, printf('x%02d', i) AS feature, round(i / 2, 6) AS value, round(c, 6) AS contribution FROM r WHERE rank <= 4""")
def strongest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest components of each vector, read as contributions, in each direction."""
    c = F.col("embedding").cast("array<double>")
    values = F.transform(c, lambda _, i: i / 2)
    found = F.array(*[F.struct(F.lit(d).alias("direction"), A.top_reasons(c, values, PLACES, 4, d).alias("top")) for d in ("up", "down", "either")])
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(found).alias("e")).select("vec_id", "e.direction", F.posexplode("e.top").alias("rank", "r"))
    return out.select("vec_id", "direction", (F.col("rank") + 1).alias("rank"), "r.feature", F.round("r.value", 6).alias("value"), F.round("r.contribution", 6).alias("contribution"))


@query(f"WITH {EACH} SELECT printf('x%02d', i) AS feature, round(avg(abs(c)), 6) AS importance FROM p GROUP BY 1")
def mean_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mean_size(table(spark, sf_dir, "embeddings"), "embedding", PLACES).withColumn("importance", F.round("importance", 6))


AP = "sum(p::DOUBLE * tp / k) / sum(p)"


@query(f"""WITH i AS (SELECT d.doc_id, quality AS label, floor(least(n_chars, 4999) / 50) / 100 AS a, n_chars % 97 / 97.0::DOUBLE AS b FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || doc_id)) AS place FROM i),
c AS (SELECT doc_id, r.r AS repeat, f, CASE f WHEN 'a' THEN a ELSE b END AS v FROM i, range(5) r(r), (SELECT unnest(['a', 'b']) AS f)),
g AS (SELECT *, row_number() OVER (PARTITION BY repeat, f ORDER BY md5('0:' || repeat || ':' || f || ':' || doc_id)) AS place FROM c),
w AS (SELECT g.repeat, g.f, label, CASE f WHEN 'a' THEN v ELSE a END * 0.75::DOUBLE + CASE f WHEN 'b' THEN v ELSE b END * 0.25::DOUBLE AS score FROM t JOIN g ON g.place = t.place
  UNION ALL SELECT -1, '', label, a * 0.75::DOUBLE + b * 0.25::DOUBLE FROM i),
e AS (SELECT repeat, f, score, sum(label) AS p, count(*) AS n FROM w GROUP BY 1, 2, 3),
s AS (SELECT *, sum(p) OVER (PARTITION BY repeat, f ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY repeat, f ORDER BY score DESC) AS k FROM e),
x AS (SELECT repeat, f, {AP} AS ap FROM s GROUP BY 1, 2)
SELECT x.f AS feature, round(avg(z.ap - x.ap), 6) AS importance, round(stddev_pop(z.ap - x.ap), 6) AS std FROM x, x z WHERE x.repeat >= 0 AND z.repeat = -1 GROUP BY 1""")
def permuted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a score of two features of labelled documents needs each of them."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a, b = F.floor(F.least("n_chars", F.lit(4999)) / 50) / 100, F.col("n_chars") % 97 / F.lit(97.0)
    rows = d.join(l, "doc_id").select("doc_id", F.col("quality").alias("label"), a.alias("a"), b.alias("b"))
    out = A.permutation_importance(rows, ["a", "b"], lambda x: x.withColumn("score", F.col("a") * 0.75 + F.col("b") * 0.25), "doc_id", 5)
    return out.select("feature", F.round("importance", 6).alias("importance"), F.round("std", 6).alias("std"))


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query()
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions to the score of trees that tell returned lines: fitted in floating point, so without SQL; the test
    holds them against the definition and against the trees' own scores."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in FEATURES])
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="keep").transform(ranking.bounded(rows, ["l_orderkey", "l_linenumber"])))
    out = A.attributed(rows, A.tree_nodes(rows, model), FEATURES)
    reasons = A.top_reasons(F.col("contributions"), F.array(*FEATURES), FEATURES, 3)
    return out.select("l_orderkey", "l_linenumber", "base", "contributions", reasons.alias("reasons"))
