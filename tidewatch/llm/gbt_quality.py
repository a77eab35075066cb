"""Histogram gradient-boosted trees over document statistics.

The trees are fitted with numpy on a bounded sample of labelled documents, flattened into arrays, and those arrays (a
few kB, bounded by the number and depth of trees) travel to the tasks, which score whole texts batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import arrow_mapped, columns_of, quoted, slices, table, without

FEATURES = [
    "log_words", "log_chars", "word_chars", "ascii_lower", "upper", "digit", "space", "newline", "symbol", "punctuation", "pipe", "exclaim", "high_bytes", "control",
    "distinct_words", "top_word", "top3_words", "distinct_pairs", "words_per_line", "dup_lines", "long_words", "one_char_words", "upper_words", "symbol_words", "url_marks", "entropy",
]
_KINDS = {"ascii_lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [32, 9], "newline": [10], "symbol": b"#*$%&<>{}[]\\^~_=+@", "punctuation": b".,;:?'\"()-", "pipe": b"|", "exclaim": b"!", "high_bytes": range(128, 256), "control": [*range(9), 11, 12, *range(14, 32)]}
_MASK = np.zeros((256, len(_KINDS)), np.float64)
for _j, _bytes in enumerate(_KINDS.values()):
    _MASK[list(_bytes), _j] = 1


def text_features(text: str | None) -> list[float]:
    """Statistics of a whole text, as FEATURES names them; zeros for null and empty texts. Nothing but the text counts."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (counts @ _MASK / len(raw)).tolist()
    p = counts[counts > 0] / len(raw)
    words = raw.split()
    n = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    top = sorted(seen.values(), reverse=True)[:3] or [0]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    marked = sum(1 for w in seen if w[-1:] in b"#*$%&")
    return [
        float(np.log1p(len(words))), float(np.log1p(len(raw))), float(lengths.sum() / n), *shares,
        len(seen) / n, top[0] / n, sum(top) / n, pairs / n, len(words) / max(1, len(lines)), (len(lines) - len(set(lines))) / max(1, len(lines)),
        float((lengths > 15).sum() / n), float((lengths == 1).sum() / n), sum(c for w, c in seen.items() if w.isupper()) / n, marked / max(1, len(seen)),
        (raw.count(b"http") + raw.count(b"www.")) / n, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Forest:
    """Trees as flat arrays: node i of a tree sends a row left if its feature is at most the cut, and leaves point at
    themselves, so that depth steps of one numpy expression walk all rows down all trees."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, leaf: float = 2.0) -> Forest:
    """Newton boosting of the logistic loss on binned features. leaf: least sum of second derivatives in a leaf.

    Without rows, or with one class only, the forest has no splits and scores the smoothed share of ones.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "value": []}
    roots = []

    def node(**given) -> int:
        i = len(nodes["value"])
        for k, default in (("feature", 0), ("cut", np.inf), ("left", i), ("right", i), ("value", 0.0)):
            nodes[k].append(given.get(k, default))
        return i

    n, width = x.shape if len(x) else (0, 1)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)] if n else []
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else None
    raw = np.full(n, base)
    for _ in range(n_trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, level: int) -> int:
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            if level < depth:
                for j in range(width):
                    gs = np.cumsum(np.bincount(binned[rows, j], g[rows], len(edges[j]) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, j], h[rows], len(edges[j]) + 1))[:-1]
                    gain = gs**2 / (hs + l2) + (sg - gs) ** 2 / (sh - hs + l2) - sg**2 / (sh + l2)
                    gain[(hs < leaf) | (sh - hs < leaf)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
            if best[1] is None:
                i = node(value=float(-rate * sg / (sh + l2)))
                raw[rows] += nodes["value"][i]
                return i
            i = node(feature=best[1], cut=float(edges[best[1]][best[2]]))
            low = binned[rows, best[1]] <= best[2]
            nodes["left"][i], nodes["right"][i] = grow(rows[low], level + 1), grow(rows[~low], level + 1)
            return i

        roots.append(grow(np.arange(n), 0))
    roots = roots or [node()]
    return Forest(np.array(nodes["feature"]), np.array(nodes["cut"]), np.array(nodes["left"]), np.array(nodes["right"]), np.array(nodes["value"]), np.array(roots), depth, base)


def with_features(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = [text_features(t.as_py()) for t in part.column(text)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(x, pa.list_(pa.float64()))], [*keep, "features"])

    rows = docs.select(*columns_of(list(dict.fromkeys([*keep, text]))))
    return arrow_mapped(rows, run, rows.select(*columns_of(keep)).withColumn("features", F.lit(None).cast("array<double>")).schema)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000, **settings) -> Forest:
    """A forest from at most `sample` labelled documents: those whose ids hash lowest, so that reruns agree.

    Rows without an id, and labels that are null, are left out; a document labelled twice counts once, with the larger
    label. Rows that repeat an id count as one document, with the mean of their features. Empty tables give a forest
    without splits.
    """
    known = labels.select(quoted(doc_id).alias("id"), quoted(label).alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("id"), F.lit(5)), "id").limit(sample)
    rows = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("t")).join(F.broadcast(chosen), "id")  # at most `sample` pairs of numbers
    means = [F.avg(F.col("features")[i]).alias(f"f{i}") for i in range(len(FEATURES))]
    found = with_features(rows, ["id", "y"], "t").groupBy("id").agg(F.first("y").alias("y"), *means).orderBy("id").collect()  # a row for each of `chosen` at most
    x = np.array([r[2:] for r in found], dtype=np.float64).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["y"] for r in found], dtype=np.float64), **settings)


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """docs with quality_score, from 0 to 1. Every row is scored by its whole text; null counts as empty.

    Texts are read one at a time, so that a very long one costs its own length. An empty table gives no rows; repeated
    rows are scored each, alike. An input column named quality_score is replaced; others come back."""
    columns = without(docs, "quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                x = np.array([text_features(t.as_py()) for t in part.column(text)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(forest.score(x))], [*columns, "quality_score"])

    rows = docs.select(*columns_of(columns))
    return arrow_mapped(rows, run, rows.withColumn("quality_score", F.lit(None).cast("double")).schema)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.coalesce(F.pmod(F.crc32(quoted(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))


def op7_histogram_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forest = train(docs, labels.filter(~held_out()))
    out = score(docs.select("doc_id", "text", held_out().alias("held_out")), forest, "text")
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
