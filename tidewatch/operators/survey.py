"""A run over all series: one row each, with what was found or why nothing was, and its summary."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.operators import series as S


def guarded(run: Callable[[pa.Table], pa.Table], schema: str, key: str = "target_id") -> tuple[Callable[[pa.Table], pa.Table], str]:
    """A kernel of one series and its schema, with a column error: null in all it returns; a series whose kernel raises has one
    row with its key, what was raised, and nulls, and the job goes on."""
    schema += ", error string"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def safe(table: pa.Table) -> pa.Table:
        try:
            out = run(table)
            return out.append_column("error", pa.nulls(out.num_rows, pa.string())).select(fields.names)
        except Exception as e:  # noqa: BLE001  whatever it is, the other series are not to blame
            row = {f.name: pa.nulls(1, f.type) for f in fields} | {key: table.column(key).slice(0, 1), "error": pa.array([f"{type(e).__name__}: {e}"])}
            return pa.table(row)

    return safe, schema


def with_status(work: Callable[[DataFrame], DataFrame], least: int, key: str = "target_id") -> Callable[[DataFrame], DataFrame]:
    """work, which gives at most one row a series, as one that gives exactly one: its columns, n_samples (finite ones) and
    status: 'short' (fewer than `least`; work does not see it), 'nothing' (work gave no row), 'error' (work has a column error
    that is not null there, see guarded()), else 'ok'.

    It fits store.update(): short and empty series are then known too and not tried again.
    """

    def run(series: DataFrame) -> DataFrame:
        good = S.finite(series)
        counts = good.groupBy(key).agg(F.count("*").alias("n_samples"))
        every = series.select(key).distinct().join(counts, key, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
        enough = good.join(counts.filter(F.col("n_samples") >= least).select(key), key, "left_semi")
        out = every.join(work(enough).withColumn("__found", F.lit(True)), key, "left")
        status = F.when(F.col("n_samples") < least, "short").when(F.col("__found").isNull(), "nothing")
        if "error" in out.columns:
            status = status.when(F.col("error").isNotNull(), "error")
        status = status.otherwise("ok")
        return out.withColumn("status", status).drop("__found")

    return run


def summary(rows: DataFrame, probability: str) -> DataFrame:
    """(status, n, n_scored, expected, best): rows, those with a probability, the positives that the probabilities promise,
    and the highest of them, by status and (status null) over all."""
    p = F.when(~F.isnan(probability), F.col(probability))
    aggregates = [F.count("*").alias("n"), F.count(p).alias("n_scored"), F.coalesce(F.sum(p), F.lit(0.0)).alias("expected"), F.max(p).alias("best")]
    return rows.rollup("status").agg(*aggregates).select("status", "n", "n_scored", "expected", "best")
