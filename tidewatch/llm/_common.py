"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType, VariantType

#: Java and Python pattern of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a list that is sent to every task, at most.
SMALL = 100_000
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


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


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What written() writes inside goes when the block ends: results must have been stored elsewhere by then."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends, lost executors cost nothing. options are the writer's."""
    path = f"{_scratch.get() or shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(text: str) -> Column:
    return F.coalesce(quoted(text), F.lit(""))


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of df but for those an operator is going to write (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def columns_of(names: list[str]) -> list[Column]:
    return [quoted(n) for n in names]


def _plain(kind: DataType) -> bool:
    """Whether values of a type can be hashed and compared."""
    if isinstance(kind, StructType):
        return all(_plain(f.dataType) for f in kind)
    return _plain(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def numbered(df: DataFrame) -> DataFrame:
    """df, whose column __row holds a whole row, with __h, __g (128 bits of hash of __row) and __j (1, 2, ... among equal
    rows). The other columns must follow from __row.

    Rows that are not repeated are not moved. Repeated ones are counted where they are, so that equals never meet in a
    task, and dealt out again in parts. Maps and variants are compared as JSON.
    """
    fields = [(F.col("__row").getField(f.name), f.dataType) for f in df.schema["__row"].dataType]
    values = [c if _plain(kind) else F.to_json(F.struct(c.alias("x"))) for c, kind in fields]
    values = [x for v in values for x in (F.isnull(v), v)]
    rows = df.withColumns({"__h": F.xxhash64(F.lit(1), *values), "__g": F.xxhash64(F.lit(2), *values)})
    again = written(rows.groupBy("__h", "__g").agg(F.count("*").alias("n")).filter("n > 1"), "repeated")
    if again.isEmpty():
        return rows.withColumn("__j", F.lit(1))
    marks = again.select("__h", "__g")
    marks = F.broadcast(marks) if again.limit(SMALL + 1).count() <= SMALL else marks
    single = rows.join(marks, ["__h", "__g"], "left_anti").withColumn("__j", F.lit(1))
    many = rows.join(marks, ["__h", "__g"], "left_semi").groupBy("__h", "__g").agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in df.columns])
    parts = many.withColumn("__part", F.explode(F.expr("sequence(0, cast((__n - 1) div 4096 AS int))"))).repartition("__h", "__g", "__part")
    back = parts.withColumn("__j", F.explode(F.expr("sequence(__part * 4096 + 1, cast(least(__n, (__part + 1) * 4096) AS int))")))
    return single.unionByName(back.select(*df.columns, "__h", "__g", "__j"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with __rank, from 0, in an order without ties. Rows are dealt out by ranges, so that no task sees all of them."""
    dealt = written(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    start = dealt.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) - 1
    return dealt.join(F.broadcast(start), "__b").withColumn("__rank", F.col("__from") + place).drop("__b", "__from")


def slices(batch: pa.RecordBatch, column: str, rows: int = 512, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most `rows` rows and, but for single rows that are longer, `most` bytes of a text column."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def arrow_mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """rows.mapInArrow(run, schema) for columns of any names: Spark's own takes a dot in a name for a field. run sees rows'
    names and gives columns in the order of schema."""
    names = rows.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns([f"c{i}" for i in range(out.num_columns)])

    places = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    return rows.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, places).toDF(*schema.names)
