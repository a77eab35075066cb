"""Statistics of a box-shaped dip at a known period, epoch and duration, for all series in one grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import epoch_number, phase, segments


def folded(series: DataFrame, period: float, epoch: float, duration: float) -> DataFrame:
    """series with phase, event (number) and in_box; the box is open at both ends."""
    return series.withColumns({
        "phase": phase(F.col("time"), period, epoch), "event": epoch_number(F.col("time"), period, epoch),
    }).withColumn("in_box", F.abs("phase") < duration / 2)


def epoch_counts(series: DataFrame, period: float, epoch: float, duration: float, key: str = "target_id") -> DataFrame:
    """(key, n_events, least): events with samples in the box, and the fewest samples of one."""
    each = folded(series, period, epoch, duration).filter("in_box").groupBy(key, "event").agg(F.count("*").alias("n"))
    return each.groupBy(key).agg(F.count("*").alias("n_events"), F.min("n").alias("least"))


def event_depths(series: DataFrame, period: float, epoch: float, duration: float, weight: Column | None = None, key: str = "target_id") -> DataFrame:
    """(key, event, depth, error, n): weighted mean of each event in the box below one baseline, which leaves out the
    boxes at phase 0 and at half the period. weight: inverse variance, 1 if not given."""
    w = F.lit(1.0) if weight is None else weight
    rows = folded(series, period, epoch, duration).withColumn("__w", w)
    other = F.abs(phase(F.col("time"), period, epoch + period / 2)) < duration / 2
    base = rows.filter(~F.col("in_box") & ~other).groupBy(key).agg((F.sum(F.col("__w") * F.col("flux")) / F.sum("__w")).alias("__b"))
    each = rows.filter("in_box").groupBy(key, "event").agg((F.sum(F.col("__w") * F.col("flux")) / F.sum("__w")).alias("__m"), (1 / F.sqrt(F.sum("__w"))).alias("error"), F.count("*").alias("n"))
    return each.join(base, key).select(key, "event", (F.col("__b") - F.col("__m")).alias("depth"), "error", "n")


def birge_ratio(depths: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, birge): root of chi-square over degrees of freedom of depths about their weighted mean; null for one."""
    w = 1 / (F.col("error") * F.col("error"))
    chi2 = F.sum(w * F.col("depth") * F.col("depth")) - F.pow(F.sum(w * F.col("depth")), F.lit(2.0)) / F.sum(w)
    out = depths.groupBy(*by).agg(F.count("*").alias("n"), chi2.alias("__c"))
    return out.select(*by, "n", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("__c"), F.lit(0.0)) / (F.col("n") - 1))).alias("birge"))


def leave_one_out_snr(depths: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, snr): the least signal-to-noise of the mean depth with one event left out; null with fewer than two."""
    w = 1 / (F.col("error") * F.col("error"))
    total = depths.groupBy(key).agg(F.sum(w).alias("__w"), F.sum(w * F.col("depth")).alias("__d"), F.count("*").alias("__n"))
    rest = depths.join(total, key).select(key, "__n", F.try_divide(F.col("__d") - w * F.col("depth"), F.sqrt(F.greatest(F.col("__w") - w, F.lit(0.0)))).alias("__s"), (F.col("__w") - w).alias("__r"))
    return rest.groupBy(key).agg(F.min(F.when((F.col("__n") > 1) & (F.col("__r") > 0), F.col("__s"))).alias("snr"))


def odd_even_sigma(depths: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, sigma): how far odd and even events differ, in errors; events of negative number count by floor."""
    w, odd = 1 / (F.col("error") * F.col("error")), F.pmod(F.col("event"), F.lit(2)) == 1

    def side(mask: Column) -> tuple[Column, Column]:
        return F.sum(F.when(mask, w)), F.sum(F.when(mask, w * F.col("depth")))

    (wo, do), (we, de) = side(odd), side(~odd)
    return depths.groupBy(key).agg((F.abs(do / wo - de / we) / F.sqrt(1 / wo + 1 / we)).alias("sigma"))


def folded_profile(series: DataFrame, period: float, epoch: float, half: float, bins: int, key: str = "target_id") -> DataFrame:
    """(key, bin, mean): mean flux in equal bins of phase within +-half; empty bins stay, with null."""
    f = series.withColumn("__p", phase(F.col("time"), period, epoch)).filter(F.abs("__p") < half)
    got = f.groupBy(key, F.floor((F.col("__p") + half) / (2 * half / bins)).cast("int").alias("bin")).agg(F.avg("flux").alias("mean"), F.count("*").alias("n"))
    every = series.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [key, "bin"], "left").select(key, "bin", "mean", F.coalesce("n", F.lit(0)).alias("n"))


def binned_median_view(series: DataFrame, period: float, epoch: float, half: float, bins: int, width: float, key: str = "target_id") -> DataFrame:
    """(key, bin, median): medians of overlapping windows of `width` about `bins` centres; empty ones stay, with null.

    A sample is dealt to the windows that hold it by arithmetic, so no range join is needed.
    """
    step = 2 * half / bins
    f = series.withColumn("__p", phase(F.col("time"), period, epoch))
    low = F.greatest(F.ceil((F.col("__p") - width / 2 + half) / step - 0.5), F.lit(0))
    high = F.least(F.floor((F.col("__p") + width / 2 + half) / step - 0.5), F.lit(bins - 1))
    f = f.withColumns({"__l": low.cast("int"), "__h": high.cast("int")}).filter("__l <= __h").withColumn("bin", F.explode(F.sequence("__l", "__h")))
    got = f.groupBy(key, "bin").agg(F.median("flux").alias("median"))
    every = series.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [key, "bin"], "left").select(key, "bin", "median")


def detection_efficiency(powers: DataFrame, key: str = "target_id", least: int = 10) -> DataFrame:
    """(key, sde): the best power above the median power, in robust sigmas; null with fewer than `least` powers."""
    m = powers.groupBy(key).agg(F.median("power").alias("__m"), F.max("power").alias("__x"), F.count("*").alias("__n"))
    s = powers.join(m, key).groupBy(key).agg((F.median(F.abs(F.col("power") - F.col("__m"))) * 1.4826).alias("__s"), F.first("__m").alias("__m"), F.first("__x").alias("__x"), F.first("__n").alias("__n"))
    return s.select(key, F.when((F.col("__n") >= least) & (F.col("__s") > 0), (F.col("__x") - F.col("__m")) / F.col("__s")).alias("sde"))


def power_contrast(powers: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, contrast): the best power over the best more than 10 % away from 1/2, 1, 2 and 3 times its period. Powers equal to nine
    digits are ties, of which the shortest period wins: a box of the same samples at two periods differs by rounding only."""
    top = powers.groupBy(key).agg(F.min(F.struct((-F.round("power", 9)).alias("m"), "period", "power")).alias("b")).select(key, F.col("b.power").alias("__x"), F.col("b.period").alias("__p"))
    apart = F.forall(F.array(*[F.lit(a) for a in (0.5, 1.0, 2.0, 3.0)]), lambda a: F.abs(F.col("period") / (a * F.col("__p")) - 1) > 0.1)
    return powers.join(top, key).groupBy(key).agg((F.first("__x") / F.max(F.when(apart, F.col("power")))).alias("contrast"))


def red_noise(series: DataFrame, width: float, key: str = "target_id") -> DataFrame:
    """(key, beta): population deviation of means of bins of `width` with two samples or more, over robust sigma by the
    root of their mean count; null with fewer than 20 samples or 4 bins."""
    bins = series.groupBy(key, F.floor(F.col("time") / width).alias("b")).agg(F.avg("flux").alias("m"), F.count("*").alias("n")).filter("n >= 2")
    got = bins.groupBy(key).agg(F.stddev_pop("m").alias("__d"), F.avg("n").alias("__c"), F.count("*").alias("__b"))
    m = series.groupBy(key).agg(F.median("flux").alias("__m"))
    s = series.join(m, key).groupBy(key).agg((F.median(F.abs(F.col("flux") - F.col("__m"))) * 1.4826).alias("__s"), F.count("*").alias("__n"))
    return s.join(got, key, "left").select(key, F.when((F.col("__n") >= 20) & (F.col("__b") >= 4) & (F.col("__s") > 0), F.col("__d") / (F.col("__s") / F.sqrt("__c"))).alias("beta"))


def time_averaging(series: DataFrame, width: float, doublings: int, gap: float, least: int = 8, full: float = 0.75, key: str = "target_id") -> DataFrame:
    """(key, beta, n_widths): how much more means of bins scatter than white noise of the samples' own deviation would, the
    median over bins of `width` and its doublings, 1 at least; n_widths is the number of widths that could be used.

    Bins start with each stretch between gaps; one counts if it holds the share `full` of the samples that it would at the
    median step, a width if that is two samples or more and it has `least` bins. The samples are summed once, into the
    narrowest bins; wider ones are made of those.
    """
    w = Window.partitionBy(key).orderBy("time")
    own = series.select(key, "flux", (F.col("time") - F.lag("time").over(w)).alias("__d")).groupBy(key).agg(F.median("__d").alias("__c"), F.stddev_pop("flux").alias("__s"), F.count("*").alias("__k"))
    parts = segments(series.select(key, "time", "flux"), gap, key)
    start = F.min("time").over(Window.partitionBy(key, "segment"))
    bins = parts.withColumn("__i", F.floor((F.col("time") - start) / width)).groupBy(key, "segment", "__i").agg(F.count("*").alias("n"), F.sum("flux").alias("s"))
    wider = bins.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(doublings))))
    wider = wider.groupBy(key, "level", "segment", F.expr("shiftright(__i, level)").alias("__j")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    expected = F.lit(width) * F.pow(F.lit(2.0), F.col("level")) / F.col("__c")
    usable = wider.join(own, key).filter((expected >= 2) & (F.col("n") >= full * expected))
    levels = usable.groupBy(key, "level").agg(F.count("*").alias("b"), F.stddev_pop(F.col("s") / F.col("n")).alias("v"), F.avg("n").alias("c"), F.first("__s").alias("__s")).filter((F.col("b") >= least) & (F.col("__s") > 0))
    ratio = F.col("v") / (F.col("__s") / F.sqrt("c") * F.sqrt(F.col("b") / (F.col("b") - 1.0)))
    got = levels.groupBy(key).agg(F.median(ratio).alias("__r"), F.count("*").alias("n_widths"))
    return own.select(key).join(got, key, "left").select(key, F.greatest(F.coalesce("__r", F.lit(1.0)), F.lit(1.0)).alias("beta"), F.coalesce("n_widths", F.lit(0)).alias("n_widths"))
