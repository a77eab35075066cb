"""Byte-level BPE with the tiktoken library and a local rank file.

Encoding runs once per Arrow batch inside the scan's own tasks: no shuffle, and memory holds one batch. Long texts are
cut beforehand where the splitting pattern is certain to cut too, so each call to the library stays small.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import arrow_mapped, columns_of, quoted, slices, table, without

RANKS = "byte_bpe_multi_50k.tiktoken"
#: An ASCII letter or digit, then a space: no match of the pattern holds both, and none looks behind.
_CUT = re.compile(r"(?<=[A-Za-z0-9]) ")


@functools.cache
def encoding(rank_file: str, pattern: str | None = None):
    """The encoder of a rank file (a path, or a name the public_tokenizers package knows), kept per process."""
    import public_tokenizers
    import tiktoken

    with open(rank_file if "/" in rank_file else public_tokenizers.path(rank_file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(rank_file, pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = 65_536) -> Iterator[str]:
    """text in parts of about `most` characters, cut only at safe places; a part without any is longer."""
    start = 0
    while len(text) - start > most:
        found = _CUT.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(encoder, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= 65_536:
        return encoder.encode_ordinary(text)
    return [i for part in pieces(text) for i in encoder.encode_ordinary(part)]


def _mapped(columns: list[str], text: str, rank_file: str, made: Callable[[object, list[str | None]], list[pa.Array]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(rank_file)
        for batch in batches:
            whole = batch.schema.field(text).type != pa.string()  # lists of ids, not texts
            for part in [batch.slice(i, 256) for i in range(0, batch.num_rows, 256)] if whole else slices(batch, text, 256):
                new = made(encoder, part.column(text).to_pylist())
                kept = [part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, *new[:-1]], [*columns, *new[-1]])

    return run


def bpe_encode(docs: DataFrame, text: str = "text", rank_file: str = RANKS) -> DataFrame:
    """docs with token_ids (array of int) and n_tokens. Null and empty texts have no tokens; every row stays.

    Input columns named token_ids or n_tokens are replaced; repeated rows are encoded each.
    """
    columns = without(docs, "token_ids", "n_tokens")

    def made(encoder, texts):
        ids = [encode(encoder, t) for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), ["token_ids", "n_tokens"]]

    schema = docs.select(*columns_of(columns)).withColumns({"token_ids": F.lit(None).cast("array<int>"), "n_tokens": F.lit(None).cast("long")}).schema
    return arrow_mapped(docs.select(*columns_of(columns)), _mapped(columns, text, rank_file, made), schema)


def bpe_decode(tokens: DataFrame, ids: str = "token_ids", rank_file: str = RANKS) -> DataFrame:
    """tokens with decoded (binary): the raw bytes of the ids, valid UTF-8 or not. Null ids give no bytes."""
    columns = without(tokens, "decoded")

    def made(encoder, lists):
        return [pa.array([encoder.decode_bytes(x or []) for x in lists], pa.binary()), ["decoded"]]

    schema = tokens.select(*columns_of(columns)).withColumn("decoded", F.lit(None).cast("binary")).schema
    return arrow_mapped(tokens.select(*columns_of(columns)), _mapped(columns, ids, rank_file, made), schema)


def bpe_round_trip(docs: DataFrame, text: str = "text", rank_file: str = RANKS) -> DataFrame:
    """docs with the text replaced by token_ids, n_tokens and round_trip: whether the ids decode to the text's bytes.

    Both ways are gone in one Python worker, and the decoded bytes never leave it. Null and empty texts have no tokens
    and come back as no bytes; every row stays. Input columns named as those made are replaced.
    """
    columns = [c for c in without(docs, "token_ids", "n_tokens", "round_trip") if c.lower() != text.lower()]

    def made(encoder, texts):
        ids = [encode(encoder, t) for t in texts]
        same = [encoder.decode_bytes(x) == (t or "").encode() for x, t in zip(ids, texts)]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_()), ["token_ids", "n_tokens", "round_trip"]]

    new = {"token_ids": F.lit(None).cast("array<int>"), "n_tokens": F.lit(None).cast("long"), "round_trip": F.lit(None).cast("boolean")}
    rows = docs.select(*columns_of(columns), quoted(text).alias("__text"))
    return arrow_mapped(rows, _mapped(columns, "__text", rank_file, made), docs.select(*columns_of(columns)).withColumns(new).schema)


def bpe_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rank_file: str = RANKS) -> DataFrame:
    """One row a document: doc_id (of any type), n_tokens, digests of its ids and of the bytes they decode to.

    Ids and bytes are made and digested batch by batch, so that neither crosses to the JVM. Null and empty texts have no
    tokens; very long ones are cut where the pattern is certain to cut. An empty table gives no rows.
    """

    def made(encoder, texts):
        ids = [encode(encoder, t) for t in texts]
        coded = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
        back = [hashlib.sha256(encoder.decode_bytes(x)).hexdigest() for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(coded), pa.array(back), ["n_tokens", "ids_sha256", "decoded_sha256"]]

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    new = {"n_tokens": F.lit(None).cast("long"), "ids_sha256": F.lit(None).cast("string"), "decoded_sha256": F.lit(None).cast("string")}
    schema = rows.select("doc_id").withColumns(new).schema
    return arrow_mapped(rows, _mapped(["doc_id"], "text", rank_file, made), schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
