"""The same series as they arrive: bins and segments over event time, rows that come late by less than the watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, folder: str, files: str, schema: str) -> DataFrame:
    """Parquet files of a folder, those that arrive later included."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def binned(samples: DataFrame, width: str, late: str, key: str = "target_id") -> DataFrame:
    """(key, start, n, mean): tumbling bins of event time."""
    w = samples.withWatermark("ts", late).groupBy(key, F.window("ts", width))
    return w.agg(F.count("*").alias("n"), F.avg("flux").alias("mean")).select(key, F.col("window.start").alias("start"), "n", "mean")


def sessions(samples: DataFrame, gap: str, late: str, key: str = "target_id") -> DataFrame:
    """(key, start, n, mean): stretches of a series without a gap of `gap` or more."""
    w = samples.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n"), F.avg("flux").alias("mean")).select(key, F.col("session_window.start").alias("start"), "n", "mean")


def drained(stream: DataFrame, spark: SparkSession, folder: str, final: bool = False) -> DataFrame:
    """The windows of a stream's present input that its watermark has closed: each is written once, by the batch that closes
    it, under the batch's number, so that a batch run twice counts once; its state goes then, and later rows of it are
    dropped. final: the input has ended, so what is still open is written too (mode "complete": for inputs at rest).
    """
    run = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = f"{run}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if final else f"{out}/batch={number}")

    query = stream.writeStream.outputMode("complete" if final else "append").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
