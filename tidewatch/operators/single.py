"""Dips that occur once or twice: box scans at every sample, the strongest that do not overlap, and periods of pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import dips
from tidewatch.operators.series import robust_sigma

EVENT = "array<struct<snr:double,time:double,duration:double,depth:double,n:bigint>>"


def noise_factor(series: DataFrame, width: float, key: str = "target_id") -> DataFrame:
    """(key, beta): robust sigma of means of bins of `width` that hold two samples or more, over what white noise would
    give; at least 1, and 1 with fewer than 8 bins."""
    bins = series.groupBy(key, F.floor(F.col("time") / width).alias("b")).agg(F.avg("flux").alias("flux"), F.count("*").alias("c")).filter("c >= 2")
    got = robust_sigma(bins, "flux", key).select(key, F.col("n").alias("__b"), F.col("sigma").alias("__s"))
    count = bins.groupBy(key).agg(F.avg("c").alias("__c"))
    white = robust_sigma(series, "flux", key).select(key, F.col("sigma").alias("__w"))
    out = white.join(got.join(count, key), key, "left")
    ratio = F.when((F.col("__b") >= 8) & (F.col("__w") > 0), F.col("__s") / (F.col("__w") / F.sqrt("__c")))
    return out.select(key, F.greatest(F.coalesce(ratio, F.lit(1.0)), F.lit(1.0)).alias("beta"))


def _per_series(series: DataFrame, run, schema: str, key: str) -> DataFrame:
    """run(Series) -> columns, for the finite samples of each series in order of time; a task holds one series."""

    def grouped(rows: pa.Table) -> pa.Table:
        made = run(_ordered(rows))
        n = len(next(iter(made.values())))
        return pa.table({key: pa.array([rows.column(key)[0].as_py()] * n, rows.schema.field(key).type), **{c: pa.array(v) for c, v in made.items()}})

    return series.select(key, "time", "flux").groupBy(key).applyInArrow(grouped, f"`{key}` {dict(series.dtypes)[key]}, {schema}")


def _ordered(rows: pa.Table) -> dips.Series:
    time, flux = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("time", "flux"))
    keep = np.isfinite(time) & np.isfinite(flux)
    order = np.argsort(time[keep], kind="stable")
    return dips.Series(time[keep][order], flux[keep][order])


def box_scan(series: DataFrame, durations: Sequence[float], rules: dips.Rules = dips.Rules(), key: str = "target_id") -> DataFrame:
    """(key, time, duration, n, depth, snr): at every sample a box of every duration about it, against the mean of one
    duration to each side, in units of the robust sigma times the noise factor of that duration. Boxes or sides with too few
    samples (rules) have no row, so neither a step nor an edge of a gap is a dip; nor has a series without scatter."""

    def run(s: dips.Series) -> dict[str, np.ndarray]:
        parts = []
        for d, _, depth, snr, n in dips.scanned(s, durations, rules):
            own = np.isfinite(snr)
            parts.append((s.time[own], np.full(own.sum(), d), n[own].astype(np.int64), depth[own], snr[own]))
        return dict(zip(("time", "duration", "n", "depth", "snr"), (np.concatenate(x) for x in zip(*parts)), strict=True))

    return _per_series(series, run, "time double, duration double, n bigint, depth double, snr double", key)


DIP = "rank int, time double, duration double, depth double, error double, snr double, n bigint, preference double, ramp boolean, minimum_period double"


def search_events(series: DataFrame, durations: Sequence[float], rules: dips.Rules = dips.Rules(), shortest: float = 0.5, step: float = 0.002, key: str = "target_id") -> DataFrame:
    """(key, rank, time, duration, depth, error, snr, n, preference, ramp, minimum_period): the strongest dips of each series
    with refined times and durations, whether a ramp describes them better, and, of those that are no ramps, the shortest
    period that nothing contradicts (tried in quarters of the median step, `step` at least, from two durations or `shortest`).

    Series of fewer than 20 samples, without scatter or without a dip have no row.
    """

    def run(s: dips.Series) -> dict[str, list]:
        found = dips.found_dips(s, durations, rules) if len(s.time) >= 20 and s.sigma > 0 else []
        for rank, e in enumerate(found, 1):
            limit = None if e["ramp"] else dips.shortest_period(s, e["time"], e["duration"], e["depth"], max(shortest, 2 * e["duration"]), max(s.step / 4, step), rules)
            e |= {"rank": rank, "preference": max(e["preference"], -1e300), "minimum_period": limit}
        kinds = {"rank": pa.int32(), "n": pa.int64(), "ramp": pa.bool_()}
        return {c: pa.array([e[c] for e in found], kinds.get(c, pa.float64())) for c in (x.split()[0] for x in DIP.split(", "))}

    return _per_series(series, run, DIP, key)


def strongest_events(scan: DataFrame, threshold: float = 7.5, most: int = 4, key: str = "target_id") -> DataFrame:
    """(key, rank, time, duration, depth, n, snr): from the strongest box down, those whose centre is no nearer to one
    already taken than half the sum of their durations; `most` a series, each at or above the threshold.

    Ties go to the earlier, then the shorter box. What is gathered a series is its boxes above the threshold.
    """
    each = F.struct((-F.col("snr")).alias("m"), "time", "duration", "depth", "n", "snr")
    rows = scan.filter(F.col("snr") >= threshold).groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("__a"))

    def step(taken: Column, x: Column) -> Column:
        blocked = F.exists(taken, lambda t: F.abs(t["time"] - x["time"]) < (t["duration"] + x["duration"]) / 2)
        item = F.array(F.struct(x["snr"].alias("snr"), x["time"].alias("time"), x["duration"].alias("duration"), x["depth"].alias("depth"), x["n"].alias("n")))
        return F.when(blocked | (F.size(taken) >= most), taken).otherwise(F.concat(taken, item))

    chosen = rows.select(key, F.aggregate("__a", F.array().cast(EVENT), step).alias("__t"))
    out = chosen.select(key, F.posexplode("__t").alias("rank", "e"))
    return out.select(key, (F.col("rank") + 1).alias("rank"), "e.time", "e.duration", "e.depth", "e.n", "e.snr")


def scanned_events(
    series: DataFrame, durations: Sequence[float], threshold: float = 7.5, most: int = 4, rules: dips.Rules = dips.Rules(), limits: dips.Rules | None = None, shortest: float = 0.5, step: float = 0.002, key: str = "target_id",
) -> DataFrame:
    """strongest_events() of box_scan() in one pass over a series, of which only the chosen boxes leave the task; with `limits`
    also their minimum_periods() under those rules, in the same pass."""

    def run(s: dips.Series) -> dict[str, pa.Array]:
        found = dips.strongest_boxes(s, durations, threshold, most, rules)
        cells = [pa.array([e[i] for e in found], kind) for i, kind in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()))]
        made = {"rank": pa.array(range(1, len(found) + 1), pa.int32())} | dict(zip(("time", "duration", "depth", "n", "snr"), cells, strict=True))
        if limits is not None:
            made["minimum_period"] = pa.array([dips.shortest_period(s, *e[:3], max(shortest, 2 * e[1]), max(s.step / 4, step), limits) for e in found], pa.float64())
        return made

    return _per_series(series, run, f"rank int, time double, duration double, depth double, n bigint, snr double{', minimum_period double' if limits is not None else ''}", key)


def like_pairs(events: DataFrame, ratio: float = 1.6, sigmas: float = 3.0, share: float = 0.2, key: str = "target_id") -> DataFrame:
    """(key, first, second, duration, depth): pairs of dips of a series whose depths are within `sigmas` errors and a share of
    their mean, and whose durations are within `ratio`; with the means of both.

    events: few a series (strongest_events() or search_events()), with time, duration, depth, snr; pairs are within a series.
    """
    a = events.select(key, *[F.col(c).alias(f"a_{c}") for c in ("time", "duration", "depth", "snr")])
    b = events.select(key, *[F.col(c).alias(f"b_{c}") for c in ("time", "duration", "depth", "snr")])
    error = F.sqrt(F.pow(F.col("a_depth") / F.col("a_snr"), F.lit(2.0)) + F.pow(F.col("b_depth") / F.col("b_snr"), F.lit(2.0)))
    like = F.abs(F.col("a_depth") - F.col("b_depth")) <= sigmas * error + share / 2 * (F.col("a_depth") + F.col("b_depth"))
    alike = F.greatest("a_duration", "b_duration") <= ratio * F.least("a_duration", "b_duration")
    pairs = a.join(b, key).filter(F.col("a_time") < F.col("b_time")).filter(like & alike)
    return pairs.select(key, F.col("a_time").alias("first"), F.col("b_time").alias("second"), ((F.col("a_duration") + F.col("b_duration")) / 2).alias("duration"), ((F.col("a_depth") + F.col("b_depth")) / 2).alias("depth"))


def duo_periods(events: DataFrame, series: DataFrame, least: float = 2.0, most: int = 30, ratio: float = 1.6, rules: dips.Rules = dips.Rules(), key: str = "target_id") -> DataFrame:
    """(key, first, second, k, period): every whole fraction 1/k of the time between two like dips of a series that is no
    shorter than `least` and two durations, and at none of whose other dips the series is flat: where a predicted dip is
    covered by samples, it must reach a share (rules) of the pair's depth. A task holds one series and its few pairs."""
    pairs = like_pairs(events, ratio, key=key)

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows:
            s = _ordered(rows)
            for first, second, duration, depth in zip(*[own.column(c).to_pylist() for c in ("first", "second", "duration", "depth")], strict=True):
                found += [(first, second, k, p) for k, p in dips.allowed_periods(s, first, second, duration, depth, least, most, rules)]
        name = own.column("__key")[0].as_py() if own.num_rows else None
        cells = [pa.array([x[j] for x in found], kind) for j, kind in enumerate((pa.float64(), pa.float64(), pa.int32(), pa.float64()))]
        return pa.table([pa.array([name] * len(found), own.schema.field("__key").type), *cells], [key, "first", "second", "k", "period"])

    both = series.select(key, "time", "flux").groupBy(key).cogroup(pairs.withColumnRenamed(key, "__key").groupBy("__key"))
    return both.applyInArrow(run, f"`{key}` {dict(series.dtypes)[key]}, first double, second double, k int, period double")


def seen_twice(series: DataFrame, signals: DataFrame, least: float = 3.0, key: str = "target_id") -> DataFrame:
    """Signals (key, period, epoch, duration) with two dips or more whose mean is `least` errors (robust sigma over the root
    of the samples) below the median of the series."""
    own = signals.select(key, "period", "epoch", "duration").distinct()
    scatter = robust_sigma(series, "flux", key).filter("sigma > 0").select(key, "median", "sigma")
    off = F.col("time") - F.col("epoch")
    number = F.rint(off / F.col("period"))
    rows = series.select(key, "time", "flux").join(scatter, key).join(own, key).filter(F.abs(off - number * F.col("period")) < F.col("duration") / 2)
    dips = rows.groupBy(key, "period", "epoch", "duration", number.cast("long").alias("__e"))
    dips = dips.agg(((F.first("median") - F.avg("flux")) * F.sqrt(F.count("*")) / F.first("sigma")).alias("__snr")).filter(F.col("__snr") >= least)
    return dips.groupBy(key, "period", "epoch", "duration").agg(F.count("*").alias("n_dips")).filter("n_dips >= 2")


def not_periodic(events: DataFrame, signals: DataFrame, key: str = "target_id", series: DataFrame | None = None, least: float = 3.0) -> DataFrame:
    """Events outside every box of the series' known signals (key, period, epoch, duration). With the series given, a signal
    counts only if at least two of its predicted dips are there, each `least` errors deep: a single dip does not hide behind
    an alias of itself."""
    if series is not None:
        signals = signals.join(seen_twice(series, signals, least, key), [key, "period", "epoch", "duration"], "left_semi")
    s = signals.select(key, *[F.col(c).alias(f"__{c}") for c in ("period", "epoch", "duration")])
    off = F.col("time") - F.col("__epoch")
    inside = F.abs(off - F.col("__period") * F.rint(off / F.col("__period"))) < (F.col("__duration") + F.col("duration")) / 2
    return events.join(s, (events[key] == s[key]) & inside, "left_anti")



def near_gaps(events: DataFrame, series: DataFrame, reach: float = 1.5, wide: float = 4.0, key: str = "target_id") -> DataFrame:
    """events with near_gap: whether `reach` durations about the event touch an end of its series, or a hole between samples
    of more than `wide` times the series' median step. Events without a series have null. Holes are a few rows a series."""
    w = Window.partitionBy(key).orderBy("time")
    steps = series.select(key, F.col("time").alias("__t"), F.lead("time").over(w).alias("__u"))
    span = steps.groupBy(key).agg(F.percentile(F.col("__u") - F.col("__t"), 0.5).alias("__c"), F.min("__t").alias("__a"), F.max("__t").alias("__b"))
    holes = steps.join(span.select(key, "__c"), key).filter(F.col("__u") - F.col("__t") > wide * F.col("__c")).select(F.col(key).alias("__k"), "__t", "__u")
    low, high = F.col("time") - reach * F.col("duration"), F.col("time") + reach * F.col("duration")
    touched = events.select(key, "time", "duration").distinct().join(holes, (F.col(key) == F.col("__k")) & (F.col("__t") < high) & (F.col("__u") > low), "left_semi").withColumn("__hole", F.lit(True))
    out = events.join(span, key, "left").join(touched, [key, "time", "duration"], "left")
    near = (low < F.col("__a")) | (high > F.col("__b")) | F.coalesce("__hole", F.lit(False))
    return out.withColumn("near_gap", near).select(*events.columns, "near_gap")


def minimum_periods(events: DataFrame, series: DataFrame, rules: dips.Rules = dips.Rules(coverage=0.0), shortest: float = 0.5, step: float = 0.002, key: str = "target_id") -> DataFrame:
    """events (with time, duration, depth) with minimum_period: the shortest period whose other dips all fall where there are
    no samples, or where the series is down by a share of the depth; the longest the series can contradict if there is none.
    Events without a series have null. A task holds one series and its few events."""
    names = [c for c in events.columns if c != "minimum_period"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*names).schema)

    def run(rows: pa.Table, e: pa.Table) -> pa.Table:
        found: list[float | None] = [None] * e.num_rows
        own = _ordered(rows) if rows.num_rows and e.num_rows else None
        if own is not None and len(own.time):
            each = zip(*(e.column(c).to_numpy(zero_copy_only=False).astype(float).tolist() for c in ("time", "duration", "depth")), strict=True)
            found = [dips.shortest_period(own, *x, max(shortest, 2 * x[1]), max(own.step / 4, step), rules) for x in each]
        return e.append_column("minimum_period", pa.array(found, pa.float64()))

    both = series.select(key, "time", "flux").groupBy(key).cogroup(events.select(*names).groupBy(key))
    return both.applyInArrow(run, f"{kinds}, minimum_period double")
