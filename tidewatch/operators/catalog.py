"""Catalogues: keys, labels, selections and matches between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left with right's columns; a key that right repeats is an error when the rows are read."""
    n = F.count("*").over(Window.partitionBy(*on))
    sure = right.withColumn("__n", n).withColumn("__ok", F.assert_true(F.col("__n") == 1, F.lit("a key of the right side repeats"))).filter(F.col("__ok").isNull())
    return left.join(sure.drop("__n", "__ok"), on, "left")


def star_labels(rows: DataFrame, key: str, label: str, weight: str, tie: str) -> DataFrame:
    """One row a star: label 1 if any of its rows has 1, 0 if all have 0, else null; and the tie-broken row of most
    weight among those that agree with the label."""
    agreed = F.when(F.max(label) == 1, 1).when((F.min(label) == 0) & (F.count(label) == F.count("*")), 0)
    star = rows.groupBy(key).agg(agreed.alias("star_label"), F.count("*").alias("n_rows"))
    best = rows.join(star, key).filter(F.col(label).eqNullSafe(F.col("star_label"))).groupBy(key).agg(F.min(F.struct((-F.coalesce(weight, F.lit(float("-inf")))).alias("m"), F.col(tie).alias("t"))).alias("b"))
    return star.join(best, key, "left").select(key, "star_label", "n_rows", F.col("b.t").alias("reference"))


def training_set(rows: DataFrame, features: DataFrame, excluded: DataFrame, key: str, label: str, weight: str, tie: str) -> DataFrame:
    """A row a star of `rows`: star_labels(), status, and the other columns of `features` where the star is used.

    status: 'excluded' (its key is in `excluded`: a star that models are judged on), 'unlabelled' (no label holds for the whole
    star), 'unmeasured' (features has no row of it), else 'used'; the first that fits. So whoever trains on the used rows, splits by
    key and reports the statuses can account for every star. features holds one row a star; of more the result has more.
    Stars without a key are left out; keys that `excluded` repeats count once. Of clashing columns that of features gives way.
    """
    stars = star_labels(rows.filter(F.col(key).isNotNull()), key, label, weight, tie)
    banned = excluded.select(F.col(key).alias("__x")).filter("__x IS NOT NULL").distinct()
    values = [c for c in features.columns if c.lower() not in {x.lower() for x in [*stars.columns, "status", "__f"]}]
    measured = features.select(F.col(key).alias("__f"), *values)
    out = stars.join(banned, F.col(key) == F.col("__x"), "left").join(measured, F.col(key) == F.col("__f"), "left")
    reasons = {"excluded": F.col("__x").isNotNull(), "unlabelled": F.col("star_label").isNull(), "unmeasured": F.col("__f").isNull()}
    status = F.coalesce(*[F.when(found, F.lit(name)) for name, found in reasons.items()], F.lit("used"))
    out = out.withColumn("status", status)
    return out.select(*stars.columns, "status", *[F.when(F.col("status") == "used", F.col(c)).alias(c) for c in values])


def nearest_ratio(left: DataFrame, right: DataFrame, a: str, b: str, tolerance: float, tie: str) -> DataFrame:
    """left's rows with the first (by tie) of right's rows whose b is within a share `tolerance` of a.

    The answer depends on a alone, so different values of a are matched, once each, and both sides keep one row a value:
    right with its first tie and its count. Values are dealt into buckets of a logarithm, and one meets its own bucket and
    the two beside it: an equi-join. Rows of left that are alike come back each; those without a match do not.
    """
    width = F.ln(F.lit(1 + 2 * tolerance))
    bucket = F.floor(F.ln(F.col("__a")) / width)
    l = left.filter(F.col(a) > 0).select(F.col(a).alias("__a")).distinct().withColumn("__k", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    r = right.filter(F.col(b) > 0).groupBy(F.col(b).alias("__b")).agg(F.min(tie).alias("__tie"), F.count("*").alias("__n"))
    r = r.withColumn("__k", F.floor(F.ln(F.col("__b")) / width))
    near = F.abs(F.col("__b") / F.col("__a") - 1) < tolerance
    met = l.join(r, "__k").filter(near).groupBy("__a").agg(F.min("__tie").alias(tie), F.sum("__n").alias("n_matches"))
    return left.join(met, F.col(a) == F.col("__a")).drop("__a")


def period_recovered(found: Column, injected: Column, tolerance: float = 0.03) -> Column:
    """Whether a period is the injected one, or its double, triple, half or third, within a share."""
    return F.exists(F.array(*[F.lit(x) for x in (1.0, 0.5, 2.0, 3.0, 1 / 3)]), lambda a: F.abs(found / injected - a) < tolerance * a)


def stratified_sample(rows: DataFrame, by: str, order: Column, n: int) -> DataFrame:
    """At most n rows of each class, in the given order; Spark cuts each partition to n a class before the exchange."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("__k") <= n).drop("__k")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A keyed store as read: the last written row of each key."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("__k = 1").drop("__k")


def parse_sectors(text: Column) -> Column:
    """'14-16,20;x' as [14, 15, 16, 20]: ranges run out, junk is dropped, the first of repeats stays."""
    parts = F.transform(F.split(text, "[,;]"), F.trim)
    good = F.filter(parts, lambda x: x.rlike("^[0-9]+(-[0-9]+)?$"))
    ends = F.transform(good, lambda x: F.transform(F.split(x, "-"), lambda y: y.cast("int")))
    return F.array_distinct(F.flatten(F.transform(ends, lambda x: F.when(x[0] <= F.element_at(x, -1), F.sequence(x[0], F.element_at(x, -1))).otherwise(F.array().cast("array<int>")))))


def first_available(targets: DataFrame, available: DataFrame, key: str, choices: str, choice: str) -> DataFrame:
    """targets (one row a key) with `choice`, the first of the array `choices` for which `available` has a row (key, choice), and
    its place from 1; both null where there is none. Choices that are null or repeated cost nothing; targets that are alike
    come back each. Neither side is collected: a row a wanted choice meets a row an available one."""
    wanted = targets.select(key, choices).distinct().select(key, F.col(choices).alias("__c"), F.posexplode(choices).alias("__at", choice))
    met = wanted.join(available.select(key, choice).distinct(), [key, choice]).groupBy(key, "__c").agg(F.min(F.struct((F.col("__at") + 1).alias("place"), choice)).alias("__b"))
    met = met.select(F.col(key).alias("__k"), "__c", F.col(f"__b.{choice}").alias(choice), "__b.place")
    return targets.join(met, targets[key].eqNullSafe(met["__k"]) & targets[choices].eqNullSafe(met["__c"]), "left").drop("__k", "__c")


def nearest_of_key(left: DataFrame, right: DataFrame, key: str, a: str, b: str, tie: str) -> DataFrame:
    """left with the row of right of the same key whose b is nearest to a: `b` and `tie` of it; of two as near the smaller b,
    of equal b the smaller tie. Null without one. No pairs are made: both sides lie in one order of values for each key, and a
    row looks at the last value of right before it and the first after it."""
    l = left.select(F.struct("*").alias("__l"), F.col(key).alias("__k"), F.col(a).cast("double").alias("__v"), F.lit(None).cast("struct<v:double,t:bigint>").alias("__r"))
    r = right.filter(F.col(b).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(b).cast("double").alias("__v")).agg(F.min(F.col(tie).cast("long")).alias("__t"))
    r = r.select(F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), "__k", "__v", F.struct(F.col("__v").alias("v"), F.col("__t").alias("t")).alias("__r"))
    w = Window.partitionBy("__k").orderBy("__v")
    before, after = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = l.unionByName(r).withColumns({"__p": F.last("__r", True).over(before), "__n": F.first("__r", True).over(after)}).filter("__l IS NOT NULL")
    upper = F.col("__p").isNull() | (F.col("__n.v") - F.col("__v") < F.col("__v") - F.col("__p.v"))
    near = F.when(F.col("__v").isNull(), F.lit(None)).when(upper & F.col("__n").isNotNull(), F.col("__n")).otherwise(F.col("__p"))
    return both.withColumn("__b", near).select("__l.*", F.col("__b.v").alias(b), F.col("__b.t").alias(tie))


def difference_in_errors(value: Column, lower: Column, upper: Column, published: Column, error: Column | None = None) -> Column:
    """How many errors a value with errors to either side is from a published one: the error towards it, and the published
    one's (0 if unknown), in quadrature. Null if a value is unknown or there is no error."""
    own = F.when(published > value, upper).otherwise(lower)
    other = F.coalesce(error, F.lit(0.0)) if error is not None else F.lit(0.0)
    return F.try_divide(value - published, F.sqrt(own * own + other * other))
