"""Benchmark passages in training documents, found through a distributed positional inverted index.

1. Each slice of documents becomes a segment: for every term of its documents the sorted places where it stands, and the
   documents' own ranges of places. Segments are rows of a stored table and hold all tokens; no term is left out.
2. Every segment gets the items that are looked for. It takes an item's windows of words, starts from the places of the
   window's rarest term in the segment, each less the term's offset, and keeps those that the next rarest terms confirm,
   until all words of the window stand where they must (a phrase) or within `slack` words of it (a near match).
3. Places of different documents are further apart than any window and its slack, so no match crosses documents.

The work grows with the documents' tokens plus, for each segment, the occurrences of the windows' rarest terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tidewatch.llm._common import arrow_mapped, quoted, slices, table, written

#: Words of a window.
WIDTH = 10
#: Bytes of text of a segment (one longer text makes a segment of its own) and of items that are searched together.
SEGMENT, TOGETHER = 8 << 20, 1 << 20
#: Items that are sent to every task hold at most so many bytes; beyond that they are joined to the segments.
SENT = 4 << 20
#: Places between two documents of a segment.
GAP = 64
#: Bytes to those that words are made of; all others become spaces.
_WORD = bytes(i if i >= 0x80 or 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def index_words(text: str | None) -> list[bytes]:
    """Words as UTF-8: ASCII letters in lower case, digits and all that is beyond ASCII; other characters separate."""
    return (text or "").encode().translate(_WORD).split()


class _Terms(dict):
    """Terms by number, in the order in which they are met."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _segment(texts: list[str | None], gap: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, how often each occurs, their places (term by term, ascending) and each text's number of words."""
    terms, codes, sizes = _Terms(), [], []
    for text in texts:
        found = index_words(text)
        codes.append(np.fromiter(map(terms.__getitem__, found), np.int32, len(found)))
        sizes.append(len(found))
    sizes = np.array(sizes, np.int64)
    code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    place = (np.arange(len(code)) + gap * np.repeat(np.arange(len(sizes)), sizes)).astype(np.int32)
    order = np.argsort(code, kind="stable")
    return list(terms), np.bincount(code, minlength=len(terms)), place[order], sizes


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gap: int = GAP) -> DataFrame:
    """The stored index, a row a segment: segment (long), doc_ids and n_words (of each of its documents), terms, counts,
    and places (32-bit numbers, term after term).

    `gap` places stand between documents, so windows of up to gap words less twice their slack can be searched. Null and
    empty texts have no words but keep their place; null ids and repeated rows are documents like others; columns but the
    two play no part. An empty table gives no segments.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = StructType([
        StructField("segment", LongType()), StructField("doc_ids", ArrayType(kind)), StructField("n_words", ArrayType(LongType())), StructField("terms", ArrayType(StringType())),
        StructField("counts", ArrayType(IntegerType())), StructField("places", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", 1 << 30, SEGMENT):
                terms, counts, places, sizes = _segment(part.column("text").to_pylist(), gap)
                ids = part.column("doc_id")
                listed = [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([sizes], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), pa.array(terms, pa.binary()).cast(pa.string())), pa.array([counts], pa.list_(pa.int32())), pa.array([places.tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *listed], schema.names)
                number += 1

    # Parquet looks at what it holds every 100 rows only, and a segment is a row of some 10 MB: all segments of a task would be held as one
    # page and one row group, here and where they are read. So it looks at every row, and a row group ends with about a segment.
    often = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size": SEGMENT}
    return written(arrow_mapped(rows, run, schema), "index", **often)


def found_starts(lists: list[tuple[np.ndarray, int]], slack: int = 0) -> np.ndarray:
    """Ascending places at which a window starts: for each word a sorted list of its places and its offset in the window.

    With slack, a start is any place such that each word stands within `slack` words of its own. Lists are taken from the
    shortest on, so that later ones are only looked up for what is left.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    places, offset = lists[0]
    starts = np.unique((places[:, None] + (np.arange(-slack, slack + 1) - offset)).ravel()) if slack else places - offset
    for places, offset in lists[1:]:
        if not len(starts):
            break
        at = np.searchsorted(places, starts + (offset - slack))
        ok = at < len(places)
        ok[ok] = places[at[ok]] <= starts[ok] + (offset + slack)
        starts = starts[ok]
    return starts


def windows_of(words: list, width: int) -> list[tuple]:
    """All runs of `width` words; fewer words are one run, none are none."""
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def _together(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int, int]:
    """Items in groups of about TOGETHER bytes (together, items), the number of groups, and all bytes."""
    rows = items.select(quoted(item_id).cast("string").alias("item"), quoted(text).alias("text")).filter("text IS NOT NULL")
    bytes_ = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    groups = max(1, -(-bytes_ // TOGETHER))
    dealt = rows.withColumn("together", F.pmod(F.xxhash64("item", "text"), F.lit(groups)).cast("int"))
    return dealt.groupBy("together").agg(F.collect_list(F.struct("item", "text")).alias("items")), groups, bytes_


def _searched(row: dict, width: int, slack: int) -> dict[str, list]:
    """Columns n_words, hits, items and near_items of a segment's documents."""
    sizes, items = np.array(row["n_words"], np.int64), row["items"] or []
    words = [index_words(x["text"]) for x in items]
    windows: dict[tuple, list[int]] = {}
    for i, found in enumerate(words):
        for w in set(windows_of(found, width)):
            windows.setdefault(w, []).append(i)
    wanted = {w.decode() for found in words for w in found}
    ends, places = np.cumsum(row["counts"], dtype=np.int64), np.frombuffer(row["places"], np.int32).astype(np.int64)
    lists = {t.encode(): places[e - c : e] for t, c, e in zip(row["terms"], row["counts"], ends.tolist(), strict=True) if t in wanted}
    gap = row["gap"]
    base = np.cumsum(sizes) - sizes + gap * np.arange(len(sizes))
    edge = np.zeros(int(base[-1] + sizes[-1]) + 1 if len(sizes) else 1, np.int64)
    pairs, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for window, owners in windows.items():
        if any(w not in lists for w in window):
            continue
        given = [(lists[w], j) for j, w in enumerate(window)]
        for reach, to in ((0, pairs), *([(slack, near)] if slack else [])):
            starts = found_starts(given, reach)
            if len(starts):
                doc = np.unique(np.searchsorted(base - reach, starts, "right") - 1)
                to.append((doc[:, None] * len(items) + np.array(owners)).ravel())
                if not reach:
                    edge[starts] += 1
                    edge[starts + len(window)] -= 1
    hit = np.flatnonzero(np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0))
    hits: list[list] = [[] for _ in sizes]
    for a, b in zip(hit[::2].tolist(), hit[1::2].tolist(), strict=True):
        d = int(np.searchsorted(base, a, "right")) - 1
        hits[d].append([a - int(base[d]), b - int(base[d])])
    exact, close = np.unique(np.concatenate(pairs)), np.unique(np.concatenate(near))

    def named(codes: np.ndarray) -> list[list[str]]:
        out: list[set] = [set() for _ in sizes]
        for c in codes.tolist():
            if items[c % len(items)]["item"] is not None:
                out[c // len(items)].add(items[c % len(items)]["item"])
        return [sorted(x) for x in out]

    return {"hits": hits, "items": named(exact), "near_items": named(np.setdiff1d(close, exact))}


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH, slack: int = 0, gap: int = GAP) -> DataFrame:
    """One row a document of the index: doc_id, n_words, hits (array of [from, to) word ranges that exact occurrences cover,
    joined), items (sorted array of string: items with an exact occurrence), near_items (those without one of which some
    window occurs nearly, each word within `slack` words of its place; none if slack is 0).

    Items without words (null, empty, only separators) are found nowhere; a null item id is never listed, but its hits
    count; repeated items are listed once. An item of fewer than `width` words is one window. Without items, no document is
    hit. `gap` is that of the index. Items are sent to the tasks if they are of at most 4 MB; beyond that they are joined to
    the segments in groups of 1 MB, so that a task holds one segment and one group at a time, and a document's groups are
    brought together.
    """
    if gap < width + 2 * slack:
        raise ValueError(f"places of different documents are {gap} apart, which is too near for windows of {width} words")
    grouped, groups, bytes_ = _together(items, item_id, text)
    each = index.withColumn("together", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    if bytes_ <= SENT:
        asked = each.join(F.broadcast(grouped), "together", "left")
    else:
        asked = index.join(each.select("segment", "together").join(grouped, "together", "left"), "segment")
    kind = index.schema["doc_ids"].dataType.elementType
    schema = StructType([
        StructField("segment", LongType()), StructField("place", IntegerType()), StructField("doc_id", kind), StructField("n_words", LongType()),
        StructField("hits", ArrayType(ArrayType(LongType()))), StructField("items", ArrayType(StringType())), StructField("near_items", ArrayType(StringType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in ("segment", "n_words", "terms", "counts", "places", "items")}
                made, n = _searched(row | {"gap": gap}, width, slack), len(row["n_words"])
                ids = one.column("doc_ids").flatten()
                cells = [pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), ids, pa.array(row["n_words"], pa.int64())]
                cells += [pa.array(made["hits"], pa.list_(pa.list_(pa.int64()))), *[pa.array(made[c], pa.list_(pa.string())) for c in ("items", "near_items")]]
                yield pa.RecordBatch.from_arrays(cells, schema.names)

    found = arrow_mapped(asked.select("segment", "doc_ids", "n_words", "terms", "counts", "places", "items"), run, schema)
    if groups == 1:
        return found.drop("segment", "place")
    # A range that two groups hit is one: ranges in order, each cut where those before it end.
    met = found.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
    )
    joined = F.expr("""aggregate(hits, CAST(array() AS ARRAY<ARRAY<BIGINT>>), (done, x) -> CASE
        WHEN size(done) = 0 OR element_at(done, -1)[1] < x[0] THEN array_append(done, x)
        ELSE array_append(slice(done, 1, size(done) - 1), array(element_at(done, -1)[0], greatest(element_at(done, -1)[1], x[1]))) END)""")
    return met.select("doc_id", "n_words", joined.alias("hits"), "items", F.array_sort(F.array_except("near_items", "items")).alias("near_items"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP13_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
f AS (SELECT p.doc_id, p.n, p.k, v.item_id FROM (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM p) p JOIN v USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM f) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
