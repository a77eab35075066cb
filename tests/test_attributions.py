"""Attributions of trees against the definition, by all sets of known features."""

from itertools import combinations
from math import factorial, isnan, nan

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import attributions as A


def expected(tree, at, x, known):
    """A tree's score when only some features are known: the others go both ways, by how many training rows did."""
    node = tree[at]
    if node.left < 0:
        return node.weight * node.prediction
    left, right = tree[node.left], tree[node.right]
    if node.feature in known:
        return expected(tree, node.left if x[node.feature] <= node.threshold else node.right, x, known)
    return (left.cover * expected(tree, node.left, x, known) + right.cover * expected(tree, node.right, x, known)) / node.cover


def shapley(trees, x):
    m = len(x)
    out = []
    for i in range(m):
        others = [j for j in range(m) if j != i]
        total = 0.0
        for k in range(m):
            for s in combinations(others, k):
                gain = sum(expected(t, 0, x, {*s, i}) - expected(t, 0, x, set(s)) for t in trees)
                total += gain * factorial(k) * factorial(m - k - 1) / factorial(m)
        out.append(total)
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    u = [F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1000)) / 1000 for i in range(3)]
    rows = spark.range(400).select("id", *[c.alias(n) for c, n in zip(u, "abc", strict=True)])
    rows = rows.withColumn("label", ((F.col("a") > 0.4) & (F.col("b") * F.col("c") > 0.2) | (F.col("c") > 0.9)).cast("int"))
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(rows)
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=4, maxDepth=4, seed=1).fit(x)
    raw = {r.id: r.raw for r in model.transform(x).select("id", vector_to_array("rawPrediction")[1].alias("raw")).collect()}
    return rows, raw, A.tree_nodes(rows, model)


def test_attributions_are_shapley_values_and_add_up(fitted):
    rows, raw, nodes = fitted
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n.tree, {})[n.id] = n
    found = A.attributed(rows, nodes, ["a", "b", "c"]).collect()
    assert len(found) == 400
    for r in found:
        assert r.base + sum(r.contributions) == pytest.approx(raw[r.id], abs=1e-9)
    for r in found[:25]:
        assert list(r.contributions) == pytest.approx(shapley(trees.values(), [r.a, r.b, r.c]), abs=1e-9)


def test_missing_values_clashing_names_and_empty_tables(spark, fitted):
    rows, _, nodes = fitted
    odd = spark.createDataFrame([(None, 0.5, nan, "x", 7)], "a double, b double, c double, base string, `d.e` int")
    r = A.attributed(odd, nodes, ["a", "b", "c"]).first()
    trees = {}
    for n in nodes.collect():
        trees.setdefault(n.tree, {})[n.id] = n
    assert list(r.contributions) == pytest.approx(shapley(trees.values(), [nan, 0.5, nan]), abs=1e-9)
    assert r["d.e"] == 7 and isinstance(r.base, float) and not isnan(r.base)
    assert A.attributed(odd.limit(0), nodes, ["a", "b", "c"]).count() == 0


def test_reasons_leave_out_zero_null_and_the_other_way(spark):
    d = spark.createDataFrame([([0.0, -2.0, 2.0, None, nan, 1.0],)], "c array<double>")
    def top(direction):
        return [(x.feature, x.contribution) for x in d.select(A.top_reasons(F.col("c"), F.col("c"), list("uvwxyz"), 2, direction).alias("t")).first().t]

    assert top("either") == [("v", -2.0), ("w", 2.0)]
    assert top("up") == [("w", 2.0), ("z", 1.0)]
    assert top("down") == [("v", -2.0)]
    with pytest.raises(KeyError):
        top("sideways")


def test_a_feature_that_is_not_used_is_not_important(spark):
    rows = spark.range(200).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"), (F.col("id") % 4).alias("a"), (F.col("id") % 7).alias("b"))
    found = {r.feature: r for r in A.permutation_importance(rows, ["a", "b"], lambda x: x.withColumn("score", -F.col("a").cast("double")), "id", 3).collect()}
    assert found["b"].importance == 0 and found["b"].std == 0
    assert found["a"].importance > 0.5


def test_no_task_learns_from_many_rows(spark):
    from tidewatch.operators import ranking

    rows = spark.range(0, 20000, 1, 1)
    sizes = [r["count"] for r in ranking.bounded(rows, ["id"], 1000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20000 and len(sizes) == 20 and max(sizes) < 1300
    assert ranking.bounded(rows, ["id"], 20000) is rows
