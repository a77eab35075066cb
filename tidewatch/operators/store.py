"""Results kept by key between runs: what is new is computed, what is known is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.catalog import latest


def fingerprints(series: DataFrame, version: str, key: str = "target_id") -> DataFrame:
    """(key, fingerprint): of the samples of a series, in any order, and the version of what computes with them."""
    sample = F.xxhash64(F.col("time"), F.col("flux"))
    sums = series.groupBy(key).agg(F.count("*").alias("n"), F.bit_xor(sample).alias("x"), F.sum(F.shiftrightunsigned(sample, 24)).alias("s"))
    return sums.select(key, F.sha2(F.concat_ws(":", F.lit(version), "n", "x", "s"), 256).alias("fingerprint"))


def missing(wanted: DataFrame, known: DataFrame, key: str = "target_id") -> DataFrame:
    """Rows of wanted (key, fingerprint) that known does not hold under the same fingerprint."""
    return wanted.join(known.select(key, "fingerprint").distinct(), [key, "fingerprint"], "left_anti")


def update(series: DataFrame, known: DataFrame | None, compute: Callable[[DataFrame], DataFrame], version: str, key: str = "target_id") -> DataFrame:
    """compute(series) for each key, with its fingerprint: read from known where that has it, else computed. `compute`
    gives at most one row a key; of repeated rows of known the one with the largest `written` counts."""
    wanted = fingerprints(series, version, key)
    if known is None:
        return compute(series).join(wanted, key)
    kept = latest(known, key, "written") if "written" in known.columns else known
    kept = kept.join(wanted, [key, "fingerprint"], "left_semi")
    todo = missing(wanted, kept, key)
    fresh = compute(series.join(todo.select(key), key, "left_semi")).join(todo, key)
    return kept.drop("written").unionByName(fresh)
