"""The driver's tables as series and catalogues."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series: (target_id, sample_id, kind, time in days since 1970, flux)."""
    e = table(spark, sf_dir, "events")
    days = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000.0)
    return e.select(F.col("user_id").alias("target_id"), F.col("event_id").alias("sample_id"), F.col("event_type").alias("kind"), days.alias("time"), F.col("value").alias("flux"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all of Spark is one process may it be
    unset; a temporary folder is then made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
