"""A data source over folders that files.write_packed() wrote: a partition a bucket, filters on the key before any file is opened."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import LongType, StringType, StructType


def bucket_of(key: object, kind: object, buckets: int) -> int | None:
    """The folder of a key, as Spark's xxhash64 deals it; None for types whose hash is not known here."""
    if isinstance(kind, LongType):
        data = struct.pack("<q", key)
    elif isinstance(kind, StringType):
        data = str(key).encode()
    else:
        return None
    h = xxhash.xxh64_intdigest(data, seed=42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


class Bucket(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class PackedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.key, self.buckets = options["path"], options.get("key", "target_id"), int(options.get("buckets", 64))
        self.names, self.kind = schema.names, schema[self.key].dataType
        self.keys: set | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership of the key; what it does not take stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.key,):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                wanted.discard(None)
                self.keys = wanted if self.keys is None else self.keys & wanted
            else:
                yield f

    def _system(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pa.fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Bucket]:
        """One a bucket that can hold a wanted key; without any, one that holds nothing."""
        system, root = self._system()
        places = {bucket_of(k, self.kind, self.buckets) for k in self.keys} if self.keys is not None else {None}
        found: dict[str, list[str]] = {}
        for f in system.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            if f.type == pa.fs.FileType.File and f.path.endswith(".parquet") and "/bucket=" in f.path:
                number = f.path.rsplit("/bucket=", 1)[1].split("/")[0]
                if None in places or int(number) in places:
                    found.setdefault(number, []).append(f.path)
        return [Bucket(sorted(x)) for _, x in sorted(found.items())] or [Bucket([])]

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        for path in partition.files:
            with system.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(256, columns=[self.key, *[n for n in self.names if n != self.key]]):
                    if self.keys is not None:
                        batch = batch.filter(pa.array([k in self.keys for k in batch.column(self.key).to_pylist()], pa.bool_()))
                    sizes = np.diff(batch.column("time").offsets.to_numpy())
                    rows = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
                    cells = [batch.column(n).take(rows) if n == self.key else batch.column(n).flatten() for n in self.names]
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(cells, self.names)


class PackedSeries(DataSource):
    """spark.read.format("packed_series").option("path", ...): key, time, flux in long form. Options: key (target_id), buckets
    (64, as they were written); a schema of other columns or another type of key can be given. Paths are those that pyarrow
    opens; for any other, files.read_packed() reads the same folders."""

    @classmethod
    def name(cls) -> str:
        return "packed_series"

    def schema(self) -> str:
        return f"`{self.options.get('key', 'target_id')}` bigint, time double, flux double"

    def reader(self, schema: StructType) -> PackedReader:
        return PackedReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedSeries)
