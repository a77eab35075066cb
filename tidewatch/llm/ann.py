"""Approximate nearest neighbours by learned partitions.

A bounded sample of distinct vectors gives a neighbour graph, which recursive bisection cuts into partitions of equal
size with few edges between them. A softmax classifier learns, for each sampled vector, in which partitions its
neighbours lie. It then assigns every vector of the table to its most probable partition and routes a query to its most
probable partitions until their probability reaches a level set on sampled vectors kept out of the fit and they hold
enough ids for a whole answer. Partitions that are large still are cut in the same way, each by a task, so that the tree
grows with the table. Partitions are scored in blocks of bounded size by matrix products, and the best are scored again,
exactly.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import quoted, table, written

#: Distinct vectors that the partitions of a node are learned from, at most; rows a partition is meant to have; rows of a block.
SAMPLE, PARTITION_ROWS, BLOCK_ROWS = 8_192, 64, 4_096
#: A node has up to 2**FAN_BITS partitions; one of more than LARGE * PARTITION_ROWS rows is a node itself, down to DEPTH.
FAN_BITS, LARGE, DEPTH = 8, 8, 7
#: Node n has nodes n * BELOW + 1, ... below; numbers of DEPTH levels fit in 64 bits.
BELOW = 2**FAN_BITS + 1
MODEL = "node long, weights array<double>, level double"


def neighbour_graph(u: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row of u (unit vectors), by cosine."""
    out = np.empty((len(u), k), np.int64)
    for i in range(0, len(u), 512):
        s = u[i : i + 512] @ u.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Part of each node of a neighbour graph; parts (a power of two) differ by a node or so.

    Each bisection orders the nodes by the slowest mode of a random walk on the graph, cuts at the median, and swaps
    equal numbers of nodes that have more neighbours on the other side.
    """
    part, rng = np.zeros(len(near), np.int64), np.random.default_rng(seed)
    for _ in range(int(math.log2(parts))):
        nxt = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            at = np.full(len(near), -1)
            at[own] = np.arange(len(own))
            inside = at[near[own]]
            edges = inside >= 0
            src, dst = np.repeat(np.arange(len(own)), edges.sum(axis=1)), inside[edges]
            src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
            degree = np.maximum(1, np.bincount(src, minlength=len(own)))
            x = rng.standard_normal(len(own))
            for _ in range(60):
                x = x / 2 + np.bincount(src, x[dst], len(own)) / degree / 2
                x -= (x * degree).sum() / degree.sum()
                x /= np.abs(x).max() or 1
            side = np.zeros(len(own), bool)
            side[np.argsort(x, kind="stable")[len(own) // 2 :]] = True
            for _ in range(8):
                gain = np.bincount(src, (side[src] != side[dst]) * 2.0 - 1, len(own))
                a, b = np.flatnonzero(side & (gain > 0)), np.flatnonzero(~side & (gain > 0))
                n = min(len(a), len(b)) // 2
                if not n:
                    break
                side[a[np.argsort(-gain[a], kind="stable")[:n]]] = False
                side[b[np.argsort(-gain[b], kind="stable")[:n]]] = True
            nxt[own] += side
        part = nxt
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_classifier(u: np.ndarray, goal: np.ndarray, steps: int = 300, rate: float = 0.1) -> np.ndarray:
    """Weights (one row more than u has columns) of a softmax classifier with soft goals, by Adam on all rows."""
    x = np.hstack([u, np.ones((len(u), 1))])
    w = np.zeros((x.shape[1], goal.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        g = x.T @ (softmax(x @ w) - goal) / len(x) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return w


def learn(vectors: np.ndarray, parts: int, k: int = 10, recall: float = 0.97, seed: int = 3) -> tuple[np.ndarray, float]:
    """(weights, level) from a sample of vectors. level: probability to cover so that the kept-out tenth finds `recall`
    of its neighbours in the partitions it is routed to."""
    u = vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    k = min(k, len(u) - 1)
    if parts == 1 or k < 1:
        return np.zeros((vectors.shape[1] + 1, 1)), 1.0
    near = neighbour_graph(u, k)
    part = balanced_partition(near, parts, seed)
    goal = np.zeros((len(u), parts))
    np.add.at(goal, (np.repeat(np.arange(len(u)), k), part[near].ravel()), 1 / (k + 1))
    goal[np.arange(len(u)), part] += 1 / (k + 1)
    test = np.arange(len(u)) % 10 == 0
    w = fit_classifier(u[~test], goal[~test])
    p = softmax(np.hstack([u, np.ones((len(u), 1))]) @ w)
    home = p.argmax(axis=1)
    order = np.argsort(-p[test], axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(test.sum(), 0), axis=1)
    before = np.cumsum(np.take_along_axis(p[test], order, axis=1), axis=1) - np.take_along_axis(p[test], order, axis=1)
    needed = np.take_along_axis(before, np.take_along_axis(rank, home[near[test]], axis=1), axis=1).ravel()
    return w, min(1.0, float(np.quantile(needed, recall)) + 1e-6)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _fitted(rows: DataFrame, large: DataFrame, sample: int, depth: int, recall: float) -> DataFrame:
    """(node, weights, level) of each large node, learned in a task from about `sample` of its rows, all if it has no more.

    Which rows is a matter of a hash of their first id, so that an attempt after a lost executor learns the same."""
    u = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(11 + depth)), F.lit(1 << 20)) / (1 << 20)
    drawn = rows.join(large, "node").filter(u * F.col("n") < sample).select("node", "n", "v", F.col("ids")[0].alias("first"))

    def fit(found: pa.Table) -> pa.Table:
        found = found.sort_by("first")
        vectors, n = _matrix(found.column("v")), found.column("n")[0].as_py()
        weights, level = learn(vectors, _parts(n, len(vectors)), recall=recall)
        return pa.table({"node": found.column("node").slice(0, 1), "weights": pa.array([weights.ravel()], pa.list_(pa.float64())), "level": pa.array([level], pa.float64())})

    return drawn.groupBy("node").applyInArrow(fit, MODEL)


def _parts(rows: int, learned: int) -> int:
    """Partitions that a node of so many rows, of which so many are learned from, is cut into: a power of two."""
    return 2 ** max(0, min(FAN_BITS, round(math.log2(max(1, rows / PARTITION_ROWS))), int(math.log2(max(1, learned / 16)))))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))


def _in_blocks(rows: DataFrame, key: Column, counts: DataFrame, name: str) -> DataFrame:
    """rows with their block of their node, of BLOCK_ROWS rows or so."""
    return rows.join(counts, "node").withColumn(name, F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")


def _for_blocks(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """rows once for each block that their node has."""
    return rows.join(counts, "node").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _sent(rows: DataFrame, key: Column, models: DataFrame, least: int | None = None) -> DataFrame:
    """Rows of nodes that have a model, with the node below: the most probable one. With `least` a row for each one that is
    asked: until those before reach the model's level and hold that many ids (models then have column held, of their parts).

    Rows and a copy of the model meet in blocks, so a node of any number of rows is many tasks' work."""
    rows = rows.join(models.select("node"), "node", "left_semi")
    counts, names = written(_counted(rows), "blocks"), rows.columns

    def send(asked: pa.Table, model: pa.Table) -> pa.Table:
        if not (asked.num_rows and model.num_rows):
            return asked.select(names).slice(0, 0)
        x = _matrix(asked.column("v"))
        x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
        weights = model.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.shape[1] + 1, -1)
        p = softmax(np.hstack([x, np.ones((len(x), 1))]) @ weights)
        if least is None:
            row, part = np.arange(len(x)), p.argmax(axis=1)
        else:
            held = np.zeros(p.shape[1], np.int64)
            for h in model.column("held")[0].as_py():
                held[h["part"]] = h["ids"]
            order = np.argsort(-p, axis=1, kind="stable")
            sorted_, inside = np.take_along_axis(p, order, axis=1), held[order]
            asked_for = (np.cumsum(sorted_, axis=1) - sorted_ <= model.column("level")[0].as_py()) | (np.cumsum(inside, axis=1) - inside < least)
            row, place = np.nonzero(asked_for & (inside > 0))
            part = order[row, place]
        out = asked.select(names).take(pa.array(row))
        below = out.column("node").to_numpy() * BELOW + part + 1
        return out.set_column(names.index("node"), "node", pa.array(below, pa.int64()))

    by = ["node", "block"]
    asked = _in_blocks(rows, key, counts, "block")
    return asked.groupBy(*by).cogroup(_for_blocks(models, counts, "block").groupBy(*by)).applyInArrow(send, rows.schema)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components there and finite, not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, sample: int = SAMPLE, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` holds for, its k nearest other rows by cosine.

    Ids keep their type, which must have an order. Vectors without a direction, rows without an id and vectors of another
    length than most (the longer, if as many) take no part. Repeated rows count once; equal vectors share one place in the
    index, with the k + 1 smallest of their ids, which are all that a top k can show. Ties go to the smaller id. With fewer
    than k others, all of them. An empty table, or one without usable vectors or queries, gives no rows. Other columns, of
    any names, are not read.

    Partitions of more than LARGE times PARTITION_ROWS are cut again, by a classifier of their own, to any depth up to DEPTH;
    what vectors too alike leave large is scored in blocks. `recall` is shared out over the depth that the table needs.
    """
    kind = vectors.schema[vec_id].dataType.simpleString()
    rows = vectors.filter(usable(quoted(vector)) & quoted(vec_id).isNotNull())
    rows = written(rows.select(quoted(vec_id).alias("id"), quoted(vector).cast("array<double>").alias("v"), queries.alias("asks")).distinct(), "vectors")
    usual = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    rows, width = rows.filter(F.size("v") == (usual.w if usual else 0)), usual.w if usual else 1
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = rows.withColumn("r", place).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = written(distinct.select(F.lit(0).cast("long").alias("node"), "v", "ids"), "index")
    asked = written(rows.filter("asks").groupBy("v").agg(F.min("id").alias("q")), "asked")
    asking = asked.select(F.lit(0).cast("long").alias("node"), "v", "q")
    total, most, first = index.count(), k + 1, F.col("ids")[0]
    taken = index.orderBy(F.xxhash64(first, F.lit(11)), first).limit(sample).select("v").toArrow().column("v")
    learned = np.array(taken.to_pylist(), np.float64).reshape(-1, width)
    each = 1 - (1 - recall) / max(1, math.ceil(math.log(max(1, total / (LARGE * PARTITION_ROWS)), 2**FAN_BITS)))
    weights, level = learn(learned, _parts(total, len(learned)), recall=each) if total else (np.zeros((width + 1, 1)), 1.0)
    models = vectors.sparkSession.createDataFrame([(0, weights.ravel().tolist(), level)], MODEL)
    leaves, routed = [], []
    for depth in range(1, DEPTH + 1):
        below = written(_sent(index, first, models), "index")
        counts = written(below.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")), "counts")
        part = F.struct(F.pmod(F.col("node") - 1, F.lit(BELOW)).cast("int").alias("part"), "ids")
        held = counts.groupBy(F.expr(f"(node - 1) div {BELOW}").alias("node")).agg(F.collect_list(part).alias("held"))
        asking = written(_sent(asking, F.col("q"), models.join(held, "node"), most), "asking")
        large = counts.filter(F.col("n") > LARGE * PARTITION_ROWS).select("node", "n")
        if depth == DEPTH or large.isEmpty():
            leaves.append(below)
            routed.append(asking)
            break
        leaves.append(below.join(large, "node", "left_anti"))
        routed.append(asking.join(large, "node", "left_anti"))
        index = below.join(large.select("node"), "node", "left_semi")
        models = written(_fitted(below, large, sample, depth, each), "models")
    leaf, ask = reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, routed)
    leaf_blocks, ask_blocks = written(_counted(leaf), "blocks"), written(_counted(ask), "blocks")

    def score(ask: pa.Table, found: pa.Table) -> pa.Table:
        q_type, ids_type = ask.schema.field("q").type, found.schema.field("ids").type
        out: tuple[list, list, list] = ([], [], [])
        if ask.num_rows and found.num_rows:
            a, b, ids = _matrix(ask.column("v")), _matrix(found.column("v")), found.column("ids").to_pylist()
            norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            unit = b / norm_b[:, None]
            for i in range(0, len(a), 256):
                s = (a[i : i + 256] / norm_a[i : i + 256, None]) @ unit.T
                m = min(len(b), most + 8)  # some more than needed: the product may round unlike the sum below
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                exact = (a[i : i + 256, None, :] * b[top]).sum(axis=2) / (norm_a[i : i + 256, None] * norm_b[top])
                for q, places, scores in zip(ask.column("q").slice(i, 256).to_pylist(), top.tolist(), exact.tolist(), strict=True):
                    for value, j in sorted(zip(scores, places, strict=True), key=lambda x: (-x[0], ids[x[1]][0]))[:most]:
                        out[0].append(q), out[1].append(ids[j]), out[2].append(value)
        return pa.table({"q": pa.array(out[0], q_type), "ids": pa.array(out[1], ids_type), "score": pa.array(out[2], pa.float64())})

    by = ["node", "block", "q_block"]
    left = _for_blocks(_in_blocks(ask, F.col("q"), ask_blocks, "q_block"), leaf_blocks, "block")
    right = _for_blocks(_in_blocks(leaf, first, leaf_blocks, "block"), ask_blocks, "q_block")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, f"q {kind}, ids array<{kind}>, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    short = met.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most)
    names = rows.filter("asks").join(asked, "v").select(F.col("id").alias("query_id"), "q")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = names.join(short.drop("r"), "q").filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
