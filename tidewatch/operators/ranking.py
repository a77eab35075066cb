"""Boosted trees over feature vectors, held out by star, with calibrated scores, and how they gain by more stars."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewatch.operators import evaluate


def by_star(rows: DataFrame, share: float, seed: int, star: str = "target_id") -> DataFrame:
    """rows with held_out: all rows of a star fall on one side, whatever else changes."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(star)), F.lit(10**6)) / 10**6
    return rows.withColumn("held_out", u < share)


#: Rows that a task learns from at most, but for the luck of a hash: Spark keeps some 200 bytes of each in a task's block.
LEARNED = 1_000_000


def bounded(rows: DataFrame, by: list[str], most: int = LEARNED) -> DataFrame:
    """rows dealt by `by`, which names a row, over as many tasks as keep each near `most` rows; as they are where they are no
    more. Files are cut by bytes, and a task of well packed ones would hold and read again millions of rows for each tree."""
    n = -(-rows.count() // most)
    return rows.repartition(n, *by) if n > 1 else rows


def trained_scores(rows: DataFrame, features: list[str], label: str = "label", trees: int = 30, depth: int = 3, seed: int = 0, folds: int = 3, star: str = "target_id") -> DataFrame:
    """rows with fold, raw (log-odds) and score (calibrated by a logistic curve over raw).

    Each fold's rows are scored by trees that saw none of its stars; classes weigh the same. Features that are null take
    the median. Training is distributed; only trees and split statistics pass through the driver.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(star)), F.lit(folds)).cast("int")
    rows = rows.withColumn("fold", u).withColumns({f: F.col(f).cast("double") for f in features})
    share = rows.groupBy().agg(F.avg(label).alias("p")).first().p
    if share is None or not 0 < share < 1:
        raise ValueError("labels of both classes are needed")
    rows = rows.withColumn("__w", F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    filled = [f"__{f}" for f in features]
    ready = VectorAssembler(inputCols=filled, outputCol="__x", handleInvalid="keep").transform(Imputer(strategy="median", inputCols=features, outputCols=filled).fit(rows).transform(rows)).drop(*filled)
    out = None
    for k in range(folds):
        model = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="__w", maxIter=trees, maxDepth=depth, seed=seed, predictionCol="__q").fit(ready.filter(F.col("fold") != k))
        part = model.transform(ready.filter(F.col("fold") == k)).withColumn("raw", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "__q")
        out = part if out is None else out.unionByName(part)
    scaled = VectorAssembler(inputCols=["raw"], outputCol="__z").transform(out)
    curve = LogisticRegression(featuresCol="__z", labelCol=label, rawPredictionCol="__r", probabilityCol="__p", predictionCol="__q").fit(scaled)
    return curve.transform(scaled).withColumn("score", vector_to_array("__p")[1]).drop("__x", "__w", "__z", "__r", "__p", "__q")


def _drawn(star: str, draw: Column, share: Column, seed: int) -> Column:
    """Whether a star is in a draw's random subset of a share of all stars. Smaller subsets of a draw lie in its larger ones."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), draw.cast("string"), F.col(star).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2**32 < share


def subset_sizes(n: int, start: int, repeats: int) -> list[tuple[int, int]]:
    """(size, draw): sizes doubling from start below n, each `repeats` times, then n once."""
    sizes = [start << i for i in range(max(0, (n - 1).bit_length())) if start << i < n]
    return [(size, draw) for size in sizes for draw in range(repeats)] + [(n, 0)]


def subset_counts(rows: DataFrame, start: int, repeats: int, label: str = "label", seed: int = 0, star: str = "target_id") -> DataFrame:
    """(size, draw, n_stars, n, positives) of the random subsets of stars that a learning curve trains on.

    A star is in a subset with all its rows. A size is met in the mean, as stars are drawn one by one; n_stars is what was
    drawn. Rows without a star or a label take no part; without rows there are no subsets, and an empty subset has no row.
    """
    rows = rows.filter(F.col(star).isNotNull() & F.col(label).isNotNull())
    n = rows.select(star).distinct().count()
    each = F.array(*[F.struct(F.lit(s).cast("long").alias("size"), F.lit(d).alias("draw")) for s, d in subset_sizes(max(n, 1), start, repeats)])
    stars = rows.groupBy(star).agg(F.count("*").alias("n"), F.sum(label).alias("p")).select(star, "n", "p", F.inline(each))
    taken = stars.filter(_drawn(star, F.col("draw"), F.col("size") / F.lit(max(n, 1)), seed))
    return taken.groupBy("size", "draw").agg(F.count("*").alias("n_stars"), F.sum("n").alias("n"), F.sum("p").cast("long").alias("positives"))


#: Fits of a learning curve that run at a time: each is a row of short jobs, which alone would leave most cores idle.
SIDE_BY_SIDE = 12
#: Rows of a subset that make a task worth its start.
WORTH = 20_000


def in_few_tasks(subset: DataFrame, n: int) -> DataFrame:
    """A subset of n rows in as few tasks as they are worth, without an exchange; trees take some twenty jobs over all of them."""
    return subset.coalesce(max(1, -(-n // WORTH)))


def learning_curve(
    rows: DataFrame, test: DataFrame, features: list[str], start: int = 100, repeats: int = 10, label: str = "label", trees: int = 30, depth: int = 3, seed: int = 0, star: str = "target_id",
) -> DataFrame:
    """(size, n_draws, mean_stars, average_precision, sd): how well trees that learned from random subsets of the stars of `rows`
    rank `test`, whose stars that `rows` has too are left out. Sizes double from start; the last is all stars. sd is null for one draw.

    Subsets without both classes are not trained on and not counted. A subset is a predicate over rows, so give rows and test as stored
    tables. What trees learn from is worked out once and kept while they do, a subset in as few tasks as its rows need; a few fits
    run side by side, and all their trees score a held-out row in one pass. Classes weigh the same in each subset. Null
    features take the median of all rows.
    """
    spark = rows.sparkSession
    rows = rows.filter(F.col(star).isNotNull() & F.col(label).isNotNull()).withColumns({f: F.col(f).cast("double") for f in features})
    test = test.join(rows.select(star).distinct(), star, "left_anti").withColumns({f: F.col(f).cast("double") for f in features})
    counts = subset_counts(rows, start, repeats, label, seed, star).filter("positives > 0 AND positives < n").orderBy(F.desc("size"), "draw").collect()  # the longest fits first
    if not counts:
        raise ValueError("labels of both classes are needed")
    total = rows.select(star).distinct().count()
    filled = [f"__{f}" for f in features]
    imputer = Imputer(strategy="median", inputCols=features, outputCols=filled).fit(rows)
    ready = lambda x: VectorAssembler(inputCols=filled, outputCol="__x", handleInvalid="keep").transform(imputer.transform(x)).select(star, label, "__x")
    learn, held = ready(rows).persist(), ready(test)

    def fitted(c: Row) -> GBTClassificationModel:
        weight = F.when(F.col(label) == 1, 0.5 * c.n / c.positives).otherwise(0.5 * c.n / (c.n - c.positives))
        part = in_few_tasks(learn.filter(_drawn(star, F.lit(c.draw), F.lit(c["size"]) / F.lit(total), seed)), c.n).withColumn("__w", weight).persist()
        try:
            return GBTClassifier(featuresCol="__x", labelCol=label, weightCol="__w", maxIter=trees, maxDepth=depth, seed=seed + c.draw, predictionCol="__q").fit(part)
        finally:
            part.unpersist()

    try:
        with ThreadPool(min(SIDE_BY_SIDE, len(counts))) as pool:
            models = pool.map(inheritable_thread_target(spark)(fitted), counts, chunksize=1)
    finally:
        learn.unpersist()
    for i, model in enumerate(models):
        held = model.setRawPredictionCol(f"__raw{i}").setProbabilityCol("").setPredictionCol("").transform(held)
    each = [F.struct(F.lit(c["size"]).cast("long").alias("size"), F.lit(c.draw).alias("draw"), vector_to_array(f"__raw{i}")[1].alias("score")) for i, c in enumerate(counts)]
    scored = held.select(F.col(label).alias("label"), F.inline(F.array(*each)))
    drawn = spark.createDataFrame([(c["size"], c.draw, c.n_stars) for c in counts], "size long, draw int, n_stars long")
    found = evaluate.average_precision(scored, ("size", "draw")).join(drawn, ["size", "draw"])
    return found.groupBy("size").agg(F.count("*").alias("n_draws"), F.avg("n_stars").alias("mean_stars"), F.avg("ap").alias("average_precision"), F.stddev_samp("ap").alias("sd"))
