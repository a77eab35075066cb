"""How the tokens of two tokenizers correspond: groups between byte offsets at which both have a token's end.

1. A text is taken apart at single spaces between graphic characters, where both tokenizers are certain to end a token and
   start the next: A's pattern begins a match there, and no piece of B goes on after a space. Equal chunks of the texts of a
   slice are encoded and aligned once.
2. A chunk is aligned by divide and conquer: near the middle of the side with fewer tokens a common end is located by
   bisection in the other; both halves are done likewise; what has no common end inside is a group.
3. A slice keeps the chunks of each document and a dictionary of its linked id pairs, with the number of its documents that
   hold each. Spark adds these up, and each slice gets back the counts of its own pairs only.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import arrow_mapped, quoted, slices, table, written

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of a slice; a longer text is a slice of its own.
SLICE = 6 << 20
#: Ends that are tried one at a time.
PROBES = 64
#: Graphic characters beside which a space is a certain cut: none is white space, composes, or is B's mark of a space.
_GRAPHIC = "!-~\xa1-\xac\xae-˿"
_CUT = re.compile(f"(?<=[{_GRAPHIC}]) (?=[{_GRAPHIC}])")
_PLAIN = re.compile(f"[{_GRAPHIC}](?:.*[{_GRAPHIC}])?", re.DOTALL)
_MARK = "▁"


def groups(a: np.ndarray, b: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Groups (a from, a to, b from, b to) of tokens in order, from ascending ends and from ranges of the same form whose
    last ends are equal.

    All ranges are halved together. The side with fewer tokens offers its ends from the middle outwards, each located by
    bisection in the other; after PROBES of them a range looks at all its ends at once.
    """
    out, todo = [], ranges
    while len(todo):
        flipped = todo[:, 1] - todo[:, 0] > todo[:, 3] - todo[:, 2]
        low = np.where(flipped, todo[:, 2], todo[:, 0])
        inside = np.where(flipped, todo[:, 3], todo[:, 1]) - low - 1  # ends but the last
        middle, cut = low + inside // 2, np.full((len(todo), 2), -1)
        active = np.flatnonzero(inside > 0)
        for step in range(PROBES):
            if not len(active):
                break
            at = middle[active] + (step + 1) // 2 * (1 if step % 2 == 0 else -1)
            valid = (at >= low[active]) & (at < low[active] + inside[active])
            for x, y, side, column in ((a, b, ~flipped, 0), (b, a, flipped, 1)):
                own = valid & side[active]
                i = at[own]
                j = np.searchsorted(y, x[i])
                same = y[j] == x[i]
                cut[active[own][same], column] = i[same] + 1
                cut[active[own][same], 1 - column] = j[same] + 1
            active = active[(cut[active, 0] < 0) & (step + 1 <= inside[active])]
        for k in active[inside[active] >= PROBES].tolist():
            x, y, column = (b, a, 1) if flipped[k] else (a, b, 0)
            i = np.arange(low[k], low[k] + inside[k])
            j = np.searchsorted(y, x[i])
            same = y[j] == x[i]
            if same.any():
                near = np.argmin(np.abs(i[same] - middle[k]))
                cut[k, column], cut[k, 1 - column] = i[same][near] + 1, j[same][near] + 1
        halved = cut[:, 0] >= 0
        out.append(todo[~halved])
        rest, cut = todo[halved], cut[halved]
        todo = np.concatenate([np.column_stack([rest[:, 0], cut[:, 0], rest[:, 2], cut[:, 1]]), np.column_stack([cut[:, 0], rest[:, 1], cut[:, 1], rest[:, 3]])])
    found = np.concatenate(out) if out else ranges
    return found[np.argsort(found[:, 0], kind="stable")]


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of tokens that share bytes, from ascending ends: each piece between two ends is of one token of each."""
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


class Pair:
    """Both tokenizers, with the lengths of their tokens in bytes."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        place = lambda name: name if "/" in name else public_tokenizers.path(name)
        self.a = Tokenizer.from_file(place(byte_level))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=place(pieces))
        # In A's vocabulary a character stands for each byte: printable bytes for themselves, the others by number after 255.
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in kept} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(kept)))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        texts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(_MARK, " ").encode() for i, t in enumerate(texts)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.cuts = not any(_MARK in t.lstrip(_MARK) for t in texts) and json.loads(self.a.to_str())["normalizer"] is None

    def encoded(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of space + text by A, and of text by B; None where either's bytes are not those of space + text."""
        a, b, whole = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text), (" " + text).encode()
        return (a, b) if b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b]) else None


@functools.cache
def pair_of(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


def _written(a: np.ndarray, b: np.ndarray, made: np.ndarray, last: np.ndarray) -> list[str]:
    """Each chunk's groups as text. last: the number of groups up to each chunk's end. Done by 4,096 chunks: numbers as Python
    objects take many times their room."""
    out = []
    for k in range(0, len(last), 4096):
        to = last[k : k + 4096]
        g0 = int(last[k - 1]) if k else 0
        own = made[g0 : to[-1]]
        if not len(own):
            out += [""] * len(to)
            continue
        i0, j0 = int(own[0, 0]), int(own[0, 2])
        x, y = a[i0 : own[-1, 1]].tolist(), b[j0 : own[-1, 3]].tolist()
        each = [f"{x[i]}|{y[m]}" if j - i == n - m == 1 else ",".join(map(str, x[i:j])) + "|" + ",".join(map(str, y[m:n])) for i, j, m, n in (own - [i0, i0, j0, j0]).tolist()]
        ends = (to - g0).tolist()
        out += [";".join(each[i:j]) for i, j in zip([0, *ends], ends)]
    return out


class Chunks(dict):
    """Chunks of a slice's texts by number, and, once aligned, what each has of tokens, groups and links."""

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        return n

    def align(self, pair: Pair) -> None:
        """Gives each chunk a row (row[number]) and fills, by row, n_a, n_b, n_groups (-1 where bytes differ), written (groups as
        text), and pairs (keys of all links, the chunk's from first[row] to first[row + 1])."""
        a, b, sizes = self._encoded(pair)
        self.n_a, self.n_b = sizes.T
        ends_a, ends_b = np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b])
        to = np.cumsum(sizes, axis=0)
        ranges = np.column_stack([to[:, 0] - self.n_a, to[:, 0], to[:, 1] - self.n_b, to[:, 1]])
        made = groups(ends_a, ends_b, ranges[self.n_a > 0])
        last = np.searchsorted(made[:, 1], to[:, 0], "right")  # groups up to each chunk's end
        self.n_groups = np.where(self.n_a == 0, -1, np.diff(last, prepend=0))
        self.written = _written(a, b, made, last)
        at_a, at_b = links(ends_a, ends_b)
        self.first = np.concatenate([[0], np.searchsorted(at_a, to[:, 0])])
        self.pairs = a[at_a] << 32 | b[at_b]

    def _encoded(self, pair: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, row after row, and how many each row has; none where bytes differ. Plain chunks are joined by
        spaces and encoded together."""
        chunks = list(self)
        plain = [i for i, c in enumerate(chunks) if len(c) < 4096 and _PLAIN.fullmatch(c) and _MARK not in c] if pair.cuts else []
        rest = np.ones(len(chunks), bool)
        ids: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        sizes, order = [np.zeros((0, 2), np.int64)], []
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            whole = pair.encoded(" ".join([chunks[i] for i in part]))
            if whole is not None:
                ends = np.cumsum([1 + len(chunks[i].encode()) for i in part])
                cuts = [np.searchsorted(np.cumsum(size[x]), ends) + 1 for x, size in zip(whole, (pair.sizes_a, pair.sizes_b), strict=True)]
                sizes.append(np.column_stack([np.diff(c, prepend=0) for c in cuts]))
                for to, x in zip(ids, whole, strict=True):
                    to.append(np.array(x, np.int64))
                order += part
                rest[part] = False
        for i in np.flatnonzero(rest).tolist():
            found = pair.encoded(chunks[i]) or ([], [])
            sizes.append(np.array([[len(x) for x in found]], np.int64))
            for to, x in zip(ids, found, strict=True):
                to.append(np.array(x, np.int64))
            order.append(i)
        self.row = np.empty(len(chunks), np.int64)
        self.row[order] = np.arange(len(chunks))
        return np.concatenate(ids[0]), np.concatenate(ids[1]), np.concatenate(sizes)


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending or small numbers as zipped differences of 32 bits."""
    return zlib.compress(np.diff(numbers, prepend=0).astype(np.int32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int32).astype(np.int64))


def _ranges(first: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places first[i] to first[i + 1] of each i of which, one after the other."""
    sizes = first[which + 1] - first[which]
    return np.repeat(first[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


_MADE = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, doc_id: str, text: str, byte_level: str, pieces: str) -> DataFrame:
    """The stored alignments. A row a document: slice, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, chunks and times
    (packed: the chunks it has, and how often). A row a slice: slice, keys and holders (its id pairs, and how many of its
    documents have each), first and pairs (packed: each chunk's links, as places in keys); its other columns are null."""
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    new = {"slice": "long"} | dict.fromkeys(_MADE, "long") | {"groups_sha256": "string", "chunks": "binary", "times": "binary", "keys": "array<bigint>", "holders": "array<int>", "first": "binary", "pairs": "binary"}
    schema = rows.select("doc_id").withColumns({k: F.lit(None).cast(v) for k, v in new.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, number = pair_of(byte_level, pieces), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", 1 << 30, SLICE):
                yield _slice(part, pair, number)
                number += 1

    def _slice(part: pa.RecordBatch, pair: Pair, number: int) -> pa.RecordBatch:
        chunks = Chunks()
        found = []
        for value in part.column("text").to_pylist():
            cut = (_CUT.split(value) if pair.cuts else [value]) if value else []
            found.append(np.fromiter(map(chunks.__getitem__, cut), np.int32, len(cut)))
        chunks.align(pair)
        chunks.clear()
        keys, place = np.unique(chunks.pairs, return_inverse=True)
        holders, n_links = np.zeros(len(keys), np.int32), np.diff(chunks.first)
        cells: dict[str, list] = {c: [] for c in (*_MADE, "groups_sha256", "chunks", "times")}
        for numbers in found:
            which = chunks.row[numbers]
            if not len(which) or (chunks.n_groups[which] < 0).any():
                made, digest, which = [0, 0, 0, 0], "", which[:0]
            else:
                made = [int(x[which].sum()) for x in (chunks.n_a, chunks.n_b, chunks.n_groups, n_links)]
                digest = hashlib.sha256(";".join([chunks.written[i] for i in which.tolist()]).encode()).hexdigest()
            once, times = np.unique(which, return_counts=True)
            holders[np.unique(place[_ranges(chunks.first, once)])] += 1
            for c, v in zip(cells, (*made, digest, _packed(once), _packed(times)), strict=True):
                cells[c].append(v)
        n = len(found)
        out = {"doc_id": pa.concat_arrays([part.column("doc_id"), pa.nulls(1, part.column("doc_id").type)]), "slice": pa.array([number] * (n + 1), pa.int64())}
        out |= {c: pa.array([*v, None], pa.int64() if c in _MADE else pa.string() if c == "groups_sha256" else pa.binary()) for c, v in cells.items()}
        own = {"keys": (keys, pa.list_(pa.int64())), "holders": (holders, pa.list_(pa.int32())), "first": (_packed(chunks.first), pa.binary()), "pairs": (_packed(place), pa.binary())}
        out |= {c: pa.array([None] * n + [v], kind) for c, (v, kind) in own.items()}
        return pa.RecordBatch.from_arrays([out[f.name] for f in schema], schema.names)

    return written(arrow_mapped(rows, run, schema), "aligned")


def pair_counts(stored: DataFrame) -> DataFrame:
    """(key, n_docs, best): each linked id pair (A's id in the upper half of key), the documents that hold it, and whether no
    pair of its A id is held by more."""
    each = stored.filter("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "holders")).alias("x")).select("x.keys", "x.holders")
    counts = written(each.groupBy(F.col("keys").alias("key")).agg(F.sum("holders").alias("n_docs")).filter("n_docs > 0"), "counts")
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy(F.expr("shiftright(key, 32)"))))


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many documents as any
    of its A id), count_sum (documents that hold the pair, summed over links), groups_sha256.

    Null and empty texts, and those that a tokenizer does not give back byte for byte, have no tokens: zeros and ''. Every
    row stays, repeated ones and those without an id too, and each counts as a document; other columns play no part. An
    empty table gives no rows. A task holds one slice of SLICE bytes, or one longer text.
    """
    stored = aligned(docs, doc_id, text, byte_level, pieces)
    wanted = stored.filter("keys IS NOT NULL").select("slice", F.posexplode("keys").alias("place", "key"))
    back = wanted.join(pair_counts(stored), "key").select(F.col("slice").alias("of"), "place", "n_docs", "best")
    kind = dict(stored.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def finished(rows: pa.Table, counts: pa.Table) -> pa.Table:
        own = np.flatnonzero(rows.column("first").is_valid().to_numpy())[0]
        first, pairs = (_unpacked(rows.column(c)[int(own)].as_py()) for c in ("first", "pairs"))
        size = int(pairs.max()) + 1 if len(pairs) else 0
        held, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = counts.column("place").to_numpy()
        held[place], best[place] = counts.column("n_docs").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
        sums = [np.concatenate([[0], np.cumsum(x[pairs])]) for x in (best, held)]
        of_chunk = [np.diff(x[first]) for x in sums]
        docs_ = rows.filter(rows.column("chunks").is_valid())
        made = [[], []]
        for once, times in zip(docs_.column("chunks").to_pylist(), docs_.column("times").to_pylist(), strict=True):
            once, times = _unpacked(once), _unpacked(times)
            for to, x in zip(made, of_chunk, strict=True):
                to.append(int((x[once] * times).sum()))
        columns = ["doc_id", *_MADE]
        return pa.table([*[docs_.column(c) for c in columns], *[pa.array(x, pa.int64()) for x in made], docs_.column("groups_sha256")], [*columns, "n_best", "count_sum", "groups_sha256"])

    rows = stored.select("slice", "doc_id", *_MADE, "groups_sha256", "chunks", "times", "first", "pairs")
    return rows.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(finished, schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
