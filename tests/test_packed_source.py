"""The data source of packed series gives what Spark's own reader gives, and opens only the folders of wanted keys."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import StructType

from tidewatch.sources import files, packed


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packed"))
    table = spark.createDataFrame([(k, i * 0.5, float(i * k)) for k in [*range(-5, 25), 1 << 40] for i in range(5)], "target_id long, time double, flux double")
    files.write_packed(table, path, buckets=8)
    packed.register(spark)
    return path, table


def test_reads_what_was_written(spark, folder):
    path, table = folder
    source = spark.read.format("packed_series").option("path", path).option("buckets", 8).load()
    assert rows(source) == rows(table) == rows(files.read_packed(spark, path, buckets=8))
    assert rows(source.filter(F.col("target_id").isin(3, 4, 999) & (F.col("time") > 1))) == rows(table.filter("target_id IN (3, 4) AND time > 1"))
    assert rows(source.filter("target_id = 1099511627776")) == rows(table.filter("target_id = 1099511627776")) and source.filter("target_id = 77").count() == 0


def test_wanted_keys_open_few_folders(folder):
    path, _ = folder
    schema = StructType.fromDDL("target_id long, time double, flux double")
    reader = packed.PackedReader({"path": path, "buckets": "8"}, schema)
    every = reader.partitions()
    left = list(reader.pushFilters([In(("target_id",), (3, 4)), EqualTo(("target_id",), 3), GreaterThan(("time",), 1.0)]))
    assert [type(f) for f in left] == [GreaterThan] and len(every) == 8 and len(reader.partitions()) == 1
    assert {k for b in reader.read(reader.partitions()[0]) for k in b.column("target_id").to_pylist()} == {3}


def test_folders_are_those_of_spark(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 62)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "k long").select(F.pmod(F.xxhash64("k"), F.lit(64))).collect()]
    assert got == [packed.bucket_of(i, StructType.fromDDL("k long")["k"].dataType, 64) for i in ids]
    words = ["", "a", "né", "a long name of a series that goes over thirty-two bytes"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "k string").select(F.pmod(F.xxhash64("k"), F.lit(64))).collect()]
    assert got == [packed.bucket_of(w, StructType.fromDDL("k string")["k"].dataType, 64) for w in words]
