"""Why a row scored as it did: exact attributions of boosted trees, the strongest reasons, importance by permutation."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.evaluate import average_precision
from tidewatch.sources.tables import shared_dir

#: Features that the splits above one leaf may test: its table has 2 to that power rows.
MOST_TESTED = 12


def tree_nodes(rows: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """(tree, weight, id, left, right, feature, threshold, prediction, cover) of a fitted model, as Spark ML saves it. Leaves
    have left = -1. rows only names the session."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), n["prediction"].alias("prediction"), n["rawCount"].cast("double").alias("cover"),
    )
    return nodes.join(spark.createDataFrame(list(enumerate(map(float, model.treeWeights))), "tree int, weight double"), "tree")


def leaf_table(value: float, shares: list[float]) -> np.ndarray:
    """Attributions of the features above a leaf, for each set of them whose conditions a row meets (bit i: the i-th).

    With S the features that are known, the leaf pays its value if a row meets all conditions of S, times the shares of
    the training rows that met the others. A feature's attribution is its Shapley value in that game.
    """
    m = len(shares)
    sets = np.arange(2**m)
    bits = (sets[:, None] >> np.arange(m)) & 1
    unknown = np.where(bits == 1, 1.0, np.array(shares)).prod(axis=1)
    pays = np.where((sets[None, :] & ~sets[:, None]) == 0, value * unknown[None, :], 0.0)  # [met, known]
    size = bits.sum(axis=1)
    out = np.zeros((2**m, m))
    for i in range(m):
        others = sets[bits[:, i] == 0]
        chance = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in size[others]])
        out[:, i] = (pays[:, others | (1 << i)] - pays[:, others]) @ chance
    return out


def _leaves(nodes: DataFrame) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """(base, leaves): for each leaf the features above it, the bounds (low, high] they must lie in, and its table. What is
    gathered is the model's size."""
    trees: dict[int, dict] = {}
    for r in nodes.toLocalIterator():
        trees.setdefault(r.tree, {})[r.id] = r
    base, leaves = 0.0, []
    for tree in trees.values():
        waiting = [(0, {})]
        while waiting:
            at, tests = waiting.pop()
            node = tree[at]
            if node.left >= 0:
                for child, left in ((node.left, True), (node.right, False)):
                    low, high, share = tests.get(node.feature, (-math.inf, math.inf, 1.0))
                    low, high = (low, min(high, node.threshold)) if left else (max(low, node.threshold), high)
                    waiting.append((child, tests | {node.feature: (low, high, share * tree[child].cover / node.cover)}))
                continue
            if len(tests) > MOST_TESTED:
                raise ValueError(f"more than {MOST_TESTED} features above a leaf")
            value, limits = node.weight * node.prediction, list(tests.values())
            base += value * math.prod(x[2] for x in limits)
            if limits:
                leaves.append((np.array(list(tests)), *(np.array([x[i] for x in limits]) for i in (0, 1)), leaf_table(value, [x[2] for x in limits])))
    return base, leaves


def attributed(rows: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """rows with base (the score before anything is known) and contributions (array, as features): their sum is the raw score.

    nodes: as of tree_nodes(), whose features are places in `features`; splits are by thresholds. Exact for any row: at each leaf the conditions a row meets
    pick a row of a table. Null and NaN go right at every split. An empty table gives no rows; columns named as the new
    ones are replaced, others come back.
    """
    base, leaves = _leaves(nodes)
    names = [c for c in rows.columns if c.lower() not in ("base", "contributions", "__x")]
    given = rows.select(*[_named(c).alias(f"__{i}") for i, c in enumerate(names)], F.array(*[_named(f).cast("double") for f in features]).alias("__x"))

    plain = given.columns[:-1]  # by place: mapInArrow takes no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, len(features))
            phi = np.zeros_like(x)
            for columns, low, high, table in leaves:
                v = x[:, columns]
                met = ~(v <= low) & ((v <= high) | np.isinf(high))
                phi[:, columns] += table[met @ (1 << np.arange(len(columns)))]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(features), pa.int32()), pa.array(phi.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.full(batch.num_rows, base)), lists], [*plain, "base", "contributions"])

    out = given.mapInArrow(run, given.drop("__x").withColumns({"base": F.lit(0.0), "contributions": F.lit(None).cast("array<double>")}).schema)
    return out.toDF(*names, "base", "contributions")


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def top_reasons(contributions: Column, values: Column, features: list[str], n: int, direction: str = "either") -> Column:
    """Array of (feature, value, contribution): the n largest contributions 'up', 'down' or in size ('either'), ties in the
    order of features. Those that are 0, null, no number or point the other way are left out; null for null contributions."""
    sizes: dict[str, Callable[[Column], Column]] = {"up": lambda c: c, "down": lambda c: -c, "either": F.abs}
    size, names = sizes[direction], F.array(*map(F.lit, features))
    each = F.transform(contributions, lambda c, i: F.struct((-size(c)).alias("m"), i.alias("i"), F.get(names, i).alias("feature"), F.get(values, i).alias("value"), c.alias("contribution")))
    found = F.slice(F.array_sort(F.filter(each, lambda e: ~F.isnan(e["m"]) & (e["m"] < 0))), 1, n)
    return F.transform(found, lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), e["contribution"].alias("contribution")))


def mean_size(rows: DataFrame, contributions: str, features: list[str]) -> DataFrame:
    """(feature, importance): the mean size of a feature's contributions."""
    each = rows.select(F.posexplode(contributions).alias("i", "c"))
    return each.groupBy(F.get(F.array(*map(F.lit, features)), F.col("i")).alias("feature")).agg(F.avg(F.abs("c")).alias("importance"))


def _placed(rows: DataFrame, digest: Column, by: list[str]) -> DataFrame:
    """rows with __place, from 1, by a digest. Places are counted within ranges of 1/4096 of all digests, behind the totals
    of the ranges before, so that no task sees all rows."""
    dealt = rows.withColumn("__d", digest).withColumn("__r", F.substring("__d", 1, 3))
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "__r").agg(F.count("*").alias("__n")).select(*by, "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    within = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__d"))
    return dealt.join(starts, [*by, "__r"]).withColumn("__place", F.col("__from") + within).drop("__d", "__r", "__from")


def permutation_importance(rows: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], unit: str, repeats: int = 10, seed: int = 0) -> DataFrame:
    """(feature, importance, std): by how much average precision falls when a feature's values are dealt to other rows, over
    a number of deals; std is over those.

    rows: label, the features and `unit`, which names a row. score adds the column score. Deals follow from seed, unit,
    feature and repeat alone. Without a positive both are null.
    """
    plain = rows.select(unit, "label", *features)
    by = ["__repeat", "__feature"]
    cases = plain.select(F.col(unit).alias("__unit"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("__repeat"), F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features]).alias("__each"))
    cases = cases.select("__unit", "__repeat", F.explode("__each").alias("e")).select("__unit", "__repeat", F.col("e.f").alias("__feature"), F.col("e.v").alias("__value"))
    given = _placed(cases, F.md5(F.concat_ws(":", F.lit(seed), "__repeat", "__feature", "__unit")), by).select(*by, "__place", "__value")
    takers = _placed(plain, F.md5(F.concat_ws(":", F.lit(seed), unit)), [])
    dealt = takers.join(given, "__place").withColumns({f: F.when(F.col("__feature") == f, F.col("__value")).otherwise(F.col(f).cast("double")) for f in features})
    fallen = average_precision(score(dealt), tuple(by)).join(F.broadcast(average_precision(score(plain)).select(F.col("ap").alias("__whole"))))
    fall = F.col("__whole") - F.col("ap")
    return fallen.groupBy(F.col("__feature").alias("feature")).agg(F.avg(fall).alias("importance"), F.stddev_pop(fall).alias("std"))
