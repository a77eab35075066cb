"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

1. A task turns each text into its set of word shingles and a sketch of T coordinates. In round i each shingle throws
   a ball into a hashed bin; a bin keeps the smallest ball of the first round that hit it. T rounds of hashed bins are
   followed by T in which every shingle is thrown into bin i, so every coordinate fills, and the number of coordinates on
   which two sketches agree is concentrated about the Jaccard similarity.
2. Texts with equal sets form a class, known by a 128-bit hash of the set; only classes are compared.
3. Coordinates are banded. Classes that share a band are candidates; each bucket's smallest class is its first pivot.
4. Candidates are verified on the full sets of shingles of their texts, each shingle known by a 64-bit hash (two different
   shingles of a pair share one less than once in 10^12 pairs of texts of 1,000 words).
5. Links form components. Buckets that still hold several components, though not all their pairs have met, make up
   families of classes. A family is cut into blocks, those of a large component holding nothing else, and every two
   blocks meet in a task, but for two of one component: the task counts all common shingles by matrix products and
   returns only links that join components. So no pair of a bucket is lost, and no list of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import arrow_mapped, columns_of, quoted, slices, table, without, written

#: Sketch coordinates and rows a band. At a similarity of 0.8 a pair misses all 36 bands six times in ten million.
COORDINATES, ROWS = 180, 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes. Rounds are thrown a few at a time; later ones only if bins are left."""
    out, free = np.full(t, np.uint64(0xFFFFFFFFFFFFFFFF)), np.uint64(0xFFFFFFFFFFFFFFFF)
    n, start = len(elements), 0
    step = max(1, -(-t * 8 // n))
    while start < 2 * t and (start == 0 or (out == free).any()):
        rounds = np.arange(start, min(start + step, 2 * t), dtype=np.uint64)
        balls = _mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _GOLD)
        bins = np.where(rounds[:, None] < t, balls % np.uint64(t), rounds[:, None] - np.uint64(t)).astype(np.int64)
        # An earlier round wins, then the smaller ball.
        keys = (rounds[:, None] << np.uint64(50)) | (balls >> np.uint64(14))
        thrown = np.full(t, free)
        np.minimum.at(thrown, bins.ravel(), keys.ravel())
        out = np.where(out == free, thrown, out)
        start += step
    return out


def band_keys(sketched: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; different bands have different keys."""
    parts = sketched[: len(sketched) // rows * rows].reshape(-1, rows)
    key = _mix(np.arange(1, len(parts) + 1, dtype=np.uint64) * _GOLD)
    for j in range(rows):
        key = _mix((key ^ parts[:, j]) * _GOLD)
    return key.view(np.int64)


def shingle_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A to Z in lower case."""
    return (text or "").encode().lower().split()


class _Hashes(dict):
    """Hashes of words. Few enough are kept that a worker's memory does not grow with the vocabulary."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 65_536:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int, hashes: _Hashes) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; fewer words than width are one shingle, no words none."""
    words = shingle_words(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    m = max(1, len(h) - width + 1)
    key = np.full(m, np.uint64(min(len(h), width)))
    for j in range(min(len(h), width)):
        key = _mix((key ^ h[j : j + m]) * _GOLD)
    return np.unique(key)


def sketches(docs: DataFrame, text: str, width: int, t: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """docs with n_shingles, set_key and bands; set_key and bands are null for texts without words."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch, text):
                n, keys, bands = [], [], []
                for value in part.column(text).to_pylist():
                    found = shingles(value, width, hashes)
                    n.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    bands.append(band_keys(sketch(found, t), rows) if len(found) else None)
                new = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *new], [*columns, "n_shingles", "set_key", "bands"])

    new = {"n_shingles": "long", "set_key": "binary", "bands": "array<bigint>"}
    return arrow_mapped(docs, run, docs.withColumns({k: F.lit(None).cast(v) for k, v in new.items()}).schema)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets satisfy 100 * intersection >= percent * union. texts: key, text."""
    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found, hashes = None, np.zeros(0, np.uint64), _Hashes()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:  # a pivot's pairs come together
                    last, found = x, shingles(x, width, hashes)
                other = shingles(y, width, hashes)
                same = len(np.intersect1d(found, other, assume_unique=True))
                keep.append(100 * same >= percent * (len(found) + len(other) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps, each a grouping and a join written to the shared folder, until all edges
    lead straight from a node to its root; the number of steps grows with the logarithm of the size of a component. Edges
    that do so from the start cost one aggregation.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = around.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        joined = around.join(low, "a")
        if large:  # larger neighbours move to the smallest
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        out = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        return out.unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()

    def are_stars(edges: DataFrame) -> bool:
        lower = edges.select(F.col("b").alias("a"), F.lit(None).cast(edges.schema["b"].dataType).alias("up"), F.lit(1).alias("low"))
        ends = edges.select("a", F.col("b").alias("up"), F.lit(0).alias("low")).unionByName(lower)
        nodes = ends.groupBy("a").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max("low").alias("low"))
        return nodes.filter("least <> most OR (low = 1 AND least IS NOT NULL)").agg(F.count("*")).first()[0] == 0

    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if are_stars(edges):
        edges = edges.distinct()
    else:
        edges = written(star(star(edges, True), False), "edges")
        while not are_stars(edges):
            edges = written(star(star(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share. Shingles of many sets go through a matrix product, the others through
    counts of the pairs they make, of which a shingle of 16 sets makes 120."""
    n, row = len(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    ids, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    row, df = row[order], np.bincount(shingle, minlength=len(ids))
    first = np.cumsum(df) - df
    out = np.zeros((n, n))
    for d in range(2, 17):
        at = first[df == d]
        if len(at):
            together = row[at[:, None] + np.arange(d)]
            i, j = np.triu_indices(d, 1)
            out += np.bincount((together[:, i] * n + together[:, j]).ravel(), minlength=n * n).reshape(n, n)
    out += out.T
    often = np.flatnonzero(df > 16)
    for start in range(0, len(often), 2048):
        part = often[start : start + 2048]
        x = np.zeros((n, len(part)), np.float32)
        for k, s in enumerate(part):
            x[row[first[s] : first[s] + df[s]], k] = 1
        out += x @ x.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def _met(members: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 384) -> DataFrame:
    """Links (a, b) that join components of a family. members: key, root, family, weight, all distinct. A block holds
    about `block` texts, or fewer longer ones: a weight is a text's shingles in thousands, 1 at least."""
    sizes = members.groupBy("family", "root").agg(F.sum("weight").alias("n"))
    pools = sizes.filter(F.col("n") < block).groupBy("family").agg(F.sum("n").alias("pool"))
    sizes = sizes.join(pools, "family", "left")
    pooled = F.pmod(F.xxhash64("root"), F.ceil(F.col("pool") / block))
    own = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / block))
    placed = members.join(sizes, ["family", "root"]).withColumn("pure", F.when(F.col("n") >= block, F.col("root")))
    placed = written(placed.select("key", "root", "family", "pure", F.when(F.col("n") >= block, own).otherwise(pooled).alias("i")), "placed")
    blocks = placed.select("family", "pure", "i").distinct().withColumn("x", F.struct("pure", "i"))
    one, two = blocks.select("family", F.col("x").alias("x")), blocks.select("family", F.col("x").alias("y"))
    meetings = one.join(two, "family").filter("x <= y AND (x.pure IS NULL OR y.pure IS NULL OR x.pure <> y.pure)")
    sides = meetings.select("family", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("z"))
    rows = sides.join(placed.withColumn("z", F.struct("pure", "i")), ["family", "z"]).join(texts, "key").select("family", "x", "y", "key", "root", "text")

    def meet(group: pa.Table) -> pa.Table:
        keys, above = group.column("key").to_pylist(), {r: r for r in group.column("root").to_pylist()}
        roots = group.column("root").to_pylist()

        def top(r: bytes) -> bytes:
            while above[r] != r:
                above[r] = r = above[above[r]]
            return r

        hashes = _Hashes()
        shared = common([shingles(x.as_py(), width, hashes) for x in group.column("text")])
        own_size = np.diag(shared)
        near = 100 * shared >= percent * (own_size[:, None] + own_size[None, :] - shared)
        out = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True):
            p, q = top(roots[i]), top(roots[j])
            if p != q:
                above[max(p, q)] = min(p, q)
                out.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return rows.groupBy("family", "x", "y").applyInArrow(meet, "a binary, b binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with n_shingles, component_id and kept.

    Two documents are linked if their sets of word shingles share at least percent % of their union. component_id is the
    smallest doc_id reachable over links (its own for texts without words, which are linked with nothing; null if no
    document there has an id), and kept says that it is the row's own: rows that repeat an id agree, and a null id is kept
    only where component_id is null too. Null texts have no words. An empty table gives no rows. Equal sets are one class
    (by a 128-bit hash) and cost no links. Very long texts are hashed one at a time, and verified with fewer others at once.
    Input columns named as the new ones (and set_key, bands) are replaced; others come back.
    """
    columns = without(docs, "n_shingles", "component_id", "kept", "set_key", "bands")
    prepared = written(sketches(docs.select(*columns_of(columns)), text, width), "sketches")
    some = prepared.filter("set_key IS NOT NULL").select(F.col("set_key").alias("key"), quoted(doc_id).alias("id"), quoted(text).alias("text"), "n_shingles", "bands")
    weight = F.greatest(F.lit(1.0), F.first("n_shingles") / 1000).alias("weight")
    classes = written(some.groupBy("key").agg(F.first("bands").alias("bands"), F.min("id").alias("least"), weight), "classes")
    banded = classes.select("key", F.explode("bands").alias("band"))
    # Buckets of several classes; of buckets with the same members one is enough.
    buckets = banded.groupBy("band").agg(
        F.count("*").alias("n"), F.min("key").alias("pivot"), F.bit_xor(F.xxhash64("key")).alias("x"),
    ).filter("n > 1").groupBy("n", "pivot", "x").agg(F.min("band").alias("band"))
    members = written(banded.join(buckets.select("band", "pivot"), "band"), "members")
    # One text of each class that is in a bucket: that of its smallest id, so that copies do not meet in a task.
    chosen = members.select("key").distinct().join(classes.select("key", "least"), "key").select(F.col("key").alias("k"), "least")
    texts = some.join(chosen, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("least")), "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = written(texts, "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        return written(verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, width, percent), "links")

    links = linked(members.filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")))
    roots = components(links)
    # A pivot has met its bucket. The others must still meet across components.
    waiting = members.filter("key <> pivot").join(roots, F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    spread = waiting.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("q"), F.min("key").alias("first")).filter("r <> q")
    waiting = written(waiting.join(spread.select("band", "first"), "band").select("key", "root", "first").distinct(), "waiting")
    if not waiting.isEmpty():
        families = components(waiting.select(F.col("first").alias("a"), F.col("key").alias("b"))).select(F.col("node").alias("key"), F.col("root").alias("family"))
        links = links.unionByName(written(_met(waiting.select("key", "root").distinct().join(families, "key").join(classes.select("key", "weight"), "key"), texts, width, percent), "links"))
        roots = components(links)
    named = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(smallest, "root").select(F.col("key").alias("set_key"), "component_id")
    out = prepared.filter("set_key IS NOT NULL").drop("bands").join(found, "set_key", "left")
    out = out.unionByName(prepared.filter("set_key IS NULL").drop("bands").withColumn("component_id", quoted(doc_id)))
    return out.select(*columns_of(columns), "n_shingles", "component_id", quoted(doc_id).eqNullSafe(F.col("component_id")).alias("kept"))


def op3_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v AND r.c < e.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.v = d.doc_id
"""
