"""Series in long form: one row a sample (target_id, time, flux, ...). Relational throughout, one exchange on target_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Makes a median absolute deviation a standard deviation, for a Gaussian.
MAD = 1.4826


def finite(series: DataFrame, *columns: str) -> DataFrame:
    """Samples whose columns (time and flux, else those named) are all there and finite."""
    for c in columns or ("time", "flux"):
        series = series.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return series


def dealt(series: DataFrame, key: str = "target_id") -> DataFrame:
    """series dealt by key over as many tasks as a shuffle has, of which Spark merges none. Spark merges tasks by their bytes, down to
    about one a core; where a search of a series costs far more than its bytes, one task too many would then double the time."""
    return series.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def first_of_each_time(series: DataFrame, order: str = "sample_id", key: str = "target_id") -> DataFrame:
    """One sample a time of a series: the first in `order`."""
    first = F.row_number().over(Window.partitionBy(key, "time").orderBy(order))
    return series.withColumn("__k", first).filter("__k = 1").drop("__k")


def normalised(series: DataFrame, key: str = "target_id") -> DataFrame:
    """flux (and flux_err) over the series' median flux; series whose median is 0 or unknown, or without a key, are left out. The one exchange
    is that of the key, so what is grouped by it next needs none."""
    out = series.filter(F.col(key).isNotNull()).withColumn("__m", F.percentile("flux", 0.5).over(Window.partitionBy(key))).filter("__m <> 0")
    for c in ("flux", "flux_err"):
        if c in series.columns:
            out = out.withColumn(c, F.col(c) / F.col("__m"))
    return out.drop("__m")


def segments(series: DataFrame, gap: float, key: str = "target_id") -> DataFrame:
    """series with segment, from 0: a gap strictly longer than `gap` starts a new one."""
    w = Window.partitionBy(key).orderBy("time")
    breaks = F.coalesce((F.col("time") - F.lag("time").over(w) > gap).cast("int"), F.lit(0))
    return series.withColumn("__b", breaks).withColumn("segment", F.sum("__b").over(w)).drop("__b")


def middle(values: Column) -> Column:
    """The median of a sorted array; null of an empty one."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def robust_scatter(series: DataFrame, column: str = "flux", key: str = "target_id") -> DataFrame:
    """(key, n, median, sigma, lowest, highest): n counts all samples, the others pass over nulls. sigma is 1.4826 times the median
    absolute deviation. A series is sorted once as an array and its deviations once more: one exchange, and no join back."""
    values = series.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col(column).cast("double"))).alias("__v"))
    known = values.select(key, "n", "__v", middle(F.col("__v")).alias("median"))
    away = F.sort_array(F.transform("__v", lambda x: F.abs(x - F.col("median"))))
    return known.select(key, "n", "median", (middle(away) * MAD).alias("sigma"), F.get("__v", F.lit(0)).alias("lowest"), F.get("__v", F.size("__v") - 1).alias("highest"))


def robust_sigma(series: DataFrame, column: str = "flux", key: str = "target_id") -> DataFrame:
    """(key, n, median, sigma) of robust_scatter."""
    return robust_scatter(series, column, key).drop("lowest", "highest")


def robust_rms(series: DataFrame, column: str = "flux", clip: float = 5.0, key: str = "target_id") -> DataFrame:
    """(key, n, kept, rms): the root mean square of the values within `clip` robust sigmas of their median; of all where sigma is 0, and
    1 where that is 0 or nothing is known. The median only decides what to drop: the mean square is a level of less scatter."""
    values = series.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col(column).cast("double"))).alias("__v")).withColumn("__m", middle(F.col("__v")))
    away = F.sort_array(F.transform("__v", lambda x: F.abs(x - F.col("__m"))))
    spread = values.withColumn("__s", middle(away) * MAD)
    kept = F.filter("__v", lambda x: ~(F.col("__s") > 0) | (F.abs(x - F.col("__m")) <= clip * F.col("__s")))
    squares = F.aggregate("__k", F.lit(0.0), lambda total, x: total + x * x)
    rms = F.sqrt(F.try_divide(squares, F.size("__k")))
    return spread.withColumn("__k", kept).select(key, "n", F.size("__k").cast("long").alias("kept"), F.when(rms > 0, rms).otherwise(1.0).alias("rms"))


def steps(series: DataFrame, key: str = "target_id") -> DataFrame:
    """series with dt and df, the differences to the sample before; null at the first."""
    w = Window.partitionBy(key).orderBy("time")
    return series.withColumns({"dt": F.col("time") - F.lag("time").over(w), "df": F.col("flux") - F.lag("flux").over(w)})


def point_to_point_sigma(series: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, sigma): the robust sigma of successive differences over the root of two; null with fewer than 3 samples."""
    d = steps(series, key).filter("df IS NOT NULL")
    out = robust_sigma(d, "df", key)
    return out.select(key, F.when(F.col("n") >= 2, F.col("sigma") / F.sqrt(F.lit(2.0))).alias("sigma"))


def cadence(series: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, cadence): the median time between samples."""
    return steps(series, key).groupBy(key).agg(F.median("dt").alias("cadence"))


def binned(series: DataFrame, width: float, key: str = "target_id") -> DataFrame:
    """Tumbling bins of `width` from half a cadence before the first sample: mean time and flux, flux_err in quadrature
    over n, and n. Bins less than half full are dropped; series no finer than 0.9 of the width pass as they are."""
    own = steps(series, key).groupBy(key).agg(F.min("time").alias("__t0"), F.median("dt").alias("__c"))
    rows = series.join(own, key)
    coarse = F.coalesce(F.col("__c") >= 0.9 * width, F.lit(True))
    index = F.floor((F.col("time") - F.col("__t0") + F.col("__c") / 2) / width)
    rows = rows.withColumn("bin", F.when(coarse, F.row_number().over(Window.partitionBy(key).orderBy("time"))).otherwise(index))
    err = F.sqrt(F.sum(F.col("flux_err") * F.col("flux_err"))) / F.count("*") if "flux_err" in series.columns else F.lit(None).cast("double")
    out = rows.groupBy(key, "bin").agg(F.avg("time").alias("time"), F.avg("flux").alias("flux"), err.alias("flux_err"), F.count("*").alias("n"), F.first("__c").alias("__c"), F.first(coarse).alias("__p"))
    return out.filter(F.col("__p") | (F.col("n") >= 0.5 * width / F.col("__c"))).drop("__c", "__p")


def stitched(series: DataFrame, key: str = "target_id", part: str = "sector") -> DataFrame:
    """Parts of a series as one: each part over its own median, a time that two parts hold kept once (smaller part), and
    the label, if there is one, only where all parts agree."""
    w = Window.partitionBy(key, part)
    out = series.withColumn("__m", F.median("flux").over(w)).filter("__m <> 0").withColumn("flux", F.col("flux") / F.col("__m")).drop("__m")
    out = first_of_each_time(out, part, key)
    if "label" in series.columns:
        each = Window.partitionBy(key)
        same = (F.min("label").over(each) == F.max("label").over(each)) & (F.count("label").over(each) == F.count("*").over(each))
        out = out.withColumn("label", F.when(same, F.col("label")))
    return out


def densest_window(series: DataFrame, length: float, key: str = "target_id") -> DataFrame:
    """(key, start, n): the stretch of `length`, beginning at a sample, that holds most samples; the first on ties."""
    within = f"count(*) OVER (PARTITION BY {key} ORDER BY time RANGE BETWEEN CURRENT ROW AND {float(length)}D FOLLOWING)"
    counted = series.select(key, "time", F.expr(within).alias("n"))
    return counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "time")).alias("b")).select(key, F.col("b.time").alias("start"), (-F.col("b.m")).alias("n"))


def winsorised(series: DataFrame, n_sigma: float = 3.0, column: str = "flux", key: str = "target_id") -> DataFrame:
    """series with the column held within n_sigma robust sigma of its median."""
    s = robust_sigma(series, column, key).select(key, "median", "sigma")
    low, high = F.col("median") - n_sigma * F.col("sigma"), F.col("median") + n_sigma * F.col("sigma")
    return series.join(s, key).withColumn(column, F.greatest(low, F.least(high, F.col(column)))).drop("median", "sigma")


def running_median(series: DataFrame, rows: int, key: str = "target_id", part: str = "segment") -> DataFrame:
    """series with trend: the median of `rows` (odd) samples about each, within its segment."""
    half = rows // 2
    w = Window.partitionBy(key, part).orderBy("time").rowsBetween(-half, half)
    return series.withColumn("trend", F.percentile("flux", 0.5).over(w))


def packed(series: DataFrame, key: str = "target_id", *columns: str) -> DataFrame:
    """One row a series: key and an array a column (time and flux, else those named), by time."""
    columns = columns or ("time", "flux")
    rest = [c for c in columns if c != "time"]
    rows = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("time", *rest))).alias("__s"))
    return rows.select(key, *[F.col(f"__s.{c}").alias(c) for c in columns])


def unpacked(series: DataFrame, key: str = "target_id", *columns: str) -> DataFrame:
    """The long form of packed()."""
    columns = columns or ("time", "flux")
    return series.select(key, F.explode(F.arrays_zip(*columns)).alias("__s")).select(key, *[F.col(f"__s.{c}").alias(c) for c in columns])


def phase(time: Column, period: Column | float, epoch: Column | float) -> Column:
    """Time folded about the epoch, in [-period / 2, period / 2)."""
    period, epoch = (x if isinstance(x, Column) else F.lit(float(x)) for x in (period, epoch))
    shifted = time - epoch + period / 2
    return shifted - period * F.floor(shifted / period) - period / 2


def epoch_number(time: Column, period: Column | float, epoch: Column | float) -> Column:
    """Which event a time belongs to: rounded half to even."""
    period, epoch = (x if isinstance(x, Column) else F.lit(float(x)) for x in (period, epoch))
    return F.rint((time - epoch) / period).cast("long")
