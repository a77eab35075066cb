"""A corpus, from documents to tokens: five stages, each written as Parquet and read again by the next.

In all stages a null text is as an empty one (it stays null in the table), a null source is a source of its own, a null
doc_id a document without labels; rows that are alike are documents each, an empty table gives no rows, and columns beside those
of documents come back as they are, whatever their names, but from the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, gbt_quality, minhash, mixing, pii
from tidewatch.llm._common import scratch, shared_dir, table, words


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def others_aside(stage: Stage) -> Stage:
    """stage, in which columns that documents do not have carry names that clash with nothing."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in DOCUMENTS else f"__other_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        return out.toDF(*docs.columns) if out.columns == names else out

    return run


@others_aside
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    forest = gbt_quality.train(docs, table(spark, sf_dir, "labels").filter(~gbt_quality.held_out()))
    return gbt_quality.score(docs, forest).filter("quality_score >= 0.3").drop("quality_score")


@others_aside
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.near_duplicates(docs).filter("kept").select(*docs.columns)


@others_aside
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data, and terms that give it away, replaced in the text."""
    out = pii.sanitise(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("sanitised")))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


@others_aside
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Draws go by all columns of a row, so that others may change them."""
    out = mixing.mix(docs, F.size(words(F.col("text"))))  # only sizes and hashes go through the duels
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)


@others_aside
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token_ids, n_tokens, and whether the ids decode to the text's bytes."""
    return bpe.bpe_round_trip(docs.select("doc_id", "source", "text"))


STAGES = [("quality", quality), ("near_duplicates", one_of_each_group), ("personal_data", without_personal_data), ("mix", mixed), ("tokens", tokens)]
#: Trees fitted in floating point, sketches and draws by hash have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's output is stored; what it wrote on the way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
