"""Two-pass external shuffle: scatter rows into memory-sized buckets by seeded hashes, then shuffle each bucket and write it.

The first pass is one exchange on (shard, bucket). The second gives the rows of a bucket, in the order of their hashes, the
places that Fisher and Yates' algorithm deals to so many rows; only bucket sizes and places are held in arrays, never rows.
A shard is several buckets laid end to end, so its size is not bounded by memory.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import columns_of, numbered, quoted, table, text_or_empty, without


def _permutation(n: str, *seed: str) -> str:
    """SQL: an array of the numbers below n, shuffled by Fisher and Yates with draws that hash the seed and the step."""
    swap = "transform(a, (x, k) -> CASE WHEN k = s.i THEN a[s.j] WHEN k = s.j THEN a[s.i] ELSE x END)"
    steps = f"transform(sequence(1, {n} - 1), i -> named_struct('i', {n} - i, 'j', cast(pmod(xxhash64({', '.join(seed)}, i), {n} - i + 1) AS int)))"
    return f"CASE WHEN {n} < 2 THEN array(0) ELSE aggregate({steps}, sequence(0, {n} - 1), (a, s) -> {swap}) END"


def external_shuffle(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 24, seed: int = 17, bucket_bytes: int = 1 << 20, bucket_rows: int = 512) -> DataFrame:
    """df's rows with size, shard, slot and grown_shard.

    size is the text's UTF-8 bytes plus 8 (null: 8). The shard depends on the key and the number of shards only: the shard
    with the largest seeded hash of (key, shard) takes the row, so one more shard (grown_shard) takes rows into itself and
    moves no other. A null key counts as the empty string. slot is the row's place in its shard, gapless from 0: buckets
    in their order, in each the order of its shuffle. It depends on the rows and the seed, not on how they are laid out.

    Buckets are chosen by a hash of the whole row, so rows of one key fill many buckets of its shard; rows equal in all
    columns are numbered, keep a slot each and fill many buckets too. Buckets hold about bucket_bytes and bucket_rows;
    a text of any length is one row. Empty tables give no rows. Input columns named as the new ones are replaced; others,
    whatever their names and types, come back.
    """
    columns = without(df, "size", "shard", "slot", "grown_shard")
    total = df.agg(F.sum(F.octet_length(text_or_empty(text)) + 8), F.count("*")).first()
    buckets = max(1, math.ceil((total[0] or 0) / n_shards / bucket_bytes), math.ceil(total[1] / n_shards / bucket_rows))
    name = F.coalesce(quoted(key).cast("string"), F.lit(""))

    def weight(shard):
        return F.xxhash64(name, F.lit(seed), F.lit(shard))

    best = F.greatest(*[F.struct(weight(s).alias("w"), F.lit(s).alias("s")) for s in range(n_shards)]) if n_shards > 1 else F.struct(weight(0).alias("w"), F.lit(0).alias("s"))
    size = F.octet_length(text_or_empty(text)).cast("long") + 8
    rows = numbered(df.select(F.struct(*columns_of(columns)).alias("__row"), best.alias("__best"), weight(n_shards).alias("__next"), size.alias("__size")))
    placed = rows.select(
        F.col("__best.s").alias("__shard"), F.pmod(F.xxhash64("__h", "__g", "__j", F.lit(seed)), F.lit(buckets)).cast("int").alias("__bucket"), "__h", "__g", "__j",
        F.when(F.col("__next") > F.col("__best.w"), n_shards).otherwise(F.col("__best.s")).alias("__grown"), "__size", "__row",
    )
    counts = placed.groupBy("__shard", "__bucket").agg(F.count("*").cast("int").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    plan = plan.select("__shard", "__bucket", "__from", F.expr(_permutation("__n", str(seed), "__shard", "__bucket")).alias("__places"))
    place = F.row_number().over(Window.partitionBy("__shard", "__bucket").orderBy("__h", "__g", "__j"))
    out = placed.withColumn("__i", place).join(plan.hint("merge"), ["__shard", "__bucket"])
    return out.select(
        *[F.col("__row").getField(c).alias(c) for c in columns], F.col("__size").alias("size"), F.col("__shard").alias("shard"),
        (F.col("__from") + F.expr("__places[__i - 1]")).alias("slot"), F.col("__grown").alias("grown_shard"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """external_shuffle()'s rows as Parquet in a folder a shard, in the order of their slots: files are cut by ranges of
    (shard, slot), so that a shard may be many files, whose names sort as its slots do."""
    rows = shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)


def op4_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", F.crc32(text_or_empty("text")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
