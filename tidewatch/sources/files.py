"""Series from files, and back: CSV, packed Parquet, JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import series as S
from tidewatch.sources.tables import shared_dir


def read_csv_series(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """(target_id, sample_id, time, flux, flux_err) of CSV files with time and flux (any case) and perhaps flux_err; a
    file is a series, named after itself, with its own order of columns. Lines that begin with # are left out. Cells that are
    no numbers are null and their rows go; of equal times the first stays; flux is over its median; missing errors are the
    point-to-point sigma.

    Lines are read as text, so that no file is read by another's header: the first line of each file names its columns.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.monotonically_increasing_id().alias("line"), "value")
    lines = lines.filter(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    cells = F.transform(F.split(F.col("value"), ","), lambda x: F.trim(F.regexp_replace(x, '^\\s*"|"\\s*$', "")))
    headers = lines.groupBy("file").agg(F.min(F.struct("line", "value")).alias("h")).select(F.col("file").alias("__file"), F.col("h.line").alias("__first"), F.transform(F.split("h.value", ","), lambda x: F.lower(F.trim(F.regexp_replace(x, '"', "")))).alias("names"))
    headers.write.parquet(kept := f"{shared_dir(spark)}/headers-{uuid.uuid4().hex}")  # a row a file
    headers = spark.read.schema(headers.schema).parquet(kept)
    if bad := headers.filter(~(F.array_contains("names", "time") & F.array_contains("names", "flux"))).first():
        raise ValueError(f"{bad['__file']} has no columns time and flux, but {bad['names']}")
    rows = lines.join(headers, F.col("file") == F.col("__file")).filter(F.col("line") > F.col("__first")).withColumn("cells", cells)
    number = lambda c: F.get("cells", F.array_position("names", F.lit(c)).cast("int") - 1).try_cast("double")
    name = F.regexp_extract(F.col("name"), r"^(.*?)(\.[^.]*)?$", 1)
    rows = rows.select(name.alias("target_id"), F.col("line").alias("sample_id"), number("time").alias("time"), number("flux").alias("flux"), number("flux_err").alias("flux_err"))
    if target is not None:
        rows = rows.filter(F.col("target_id") == target)
    out = S.normalised(S.first_of_each_time(S.finite(rows)))
    return out.join(S.point_to_point_sigma(out), "target_id", "left").withColumn("flux_err", F.coalesce("flux_err", "sigma")).drop("sigma")


def write_packed(series: DataFrame, path: str, buckets: int = 64, key: str = "target_id") -> None:
    """One row a series, with arrays by time, in `buckets` folders by hash of the key: a later read of some keys opens few."""
    packed = S.packed(series, key).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_packed(spark: SparkSession, path: str, keys: list | None = None, buckets: int = 64, key: str = "target_id") -> DataFrame:
    """The long form of write_packed(); `keys` (few) prunes folders."""
    rows = spark.read.parquet(path)
    if keys is not None:
        kind = dict(rows.dtypes)[key]
        wanted = spark.createDataFrame([(k,) for k in keys], f"k {kind}").select(F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("b"))
        rows = rows.filter(F.col("bucket").isin(sorted({r.b for r in wanted.collect()})) & F.col(key).isin(keys))
    return S.unpacked(rows, key)


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; torn or foreign lines are dropped."""
    fields = f"{schema}, _torn string"
    rows = spark.read.schema(fields).option("columnNameOfCorruptRecord", "_torn").json(path)
    return rows.filter("_torn IS NULL").drop("_torn")
