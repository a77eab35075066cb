"""Views: a series folded at its signal, as five arrays of medians of fixed lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import MAD, phase

NAMES = ["global", "local", "odd", "even", "secondary"]


def make_views(series: DataFrame, signals: DataFrame, global_bins: int = 2001, local_bins: int = 201, durations: float = 4.0, bin_width: float = 0.16, mask: float = 1.0, key: str = "target_id") -> DataFrame:
    """(key, view, bin, value): five views of each series at its signal (key, period, epoch, duration; a row a series).

    global spans a period in bins side by side; the others span `durations` to each side (half a period at most), in
    overlapping bins of bin_width durations: local about the dip, odd and even about the dips of odd and even number,
    secondary about half a period on. A bin is the median flux less 1; one without samples lies on the line between its
    neighbours, or level with the last; a view without any is flat. Then the level outside `mask` durations is taken off, and all is
    divided by the depth of the local view, or, where that does not dip, by the robust scatter outside. Signals without a positive period and duration, and
    series without samples near the dip, give no rows.

    A sample is dealt to the bins that hold it by arithmetic; medians are one grouping by (key, view, bin).
    """
    sound = signals.select(key, "period", "epoch", "duration").filter("period > 0 AND duration > 0 AND epoch IS NOT NULL")
    p, e, d = F.col("period"), F.col("epoch"), F.col("duration")
    half = F.least(durations * d, p / 2)
    rows = series.select(key, "time", "flux").join(sound, key).withColumns({"__p": phase(F.col("time"), p, e), "__h": phase(F.col("time"), p, e + p / 2), "__y": F.col("flux") - 1})
    odd = F.pmod(F.rint((F.col("time") - e) / p).cast("long"), F.lit(2)) == 1

    def place(name: str, x: str, half_, bins: int, width):
        return F.struct(F.lit(name).alias("view"), F.col(x).alias("x"), half_.alias("half"), F.lit(bins).alias("bins"), width.alias("width"))

    local = half, local_bins, bin_width * d
    places = F.array(place("global", "__p", p / 2, global_bins, p / global_bins), place("local", "__p", *local), F.when(odd, place("odd", "__p", *local)).otherwise(place("even", "__p", *local)), place("secondary", "__h", *local))
    dealt = rows.select(key, "__y", F.explode(places).alias("v")).select(key, "__y", "v.*")
    step = 2 * F.col("half") / F.col("bins")
    low = F.greatest(F.ceil((F.col("x") - F.col("width") / 2 + F.col("half")) / step - 0.5), F.lit(0)).cast("int")
    high = F.least(F.floor((F.col("x") + F.col("width") / 2 + F.col("half")) / step - 0.5), F.col("bins") - 1).cast("int")
    dealt = dealt.withColumns({"__l": low, "__u": high}).filter("__l <= __u").withColumn("bin", F.explode(F.sequence("__l", "__u")))
    medians = dealt.groupBy(key, "view", "bin").agg(F.median("__y").alias("m"))

    outside = F.abs("__p") > mask * d
    level = rows.groupBy(key).agg(F.coalesce(F.median(F.when(outside, F.col("__y"))), F.lit(0.0)).alias("__level"), F.count(F.when(F.abs("__p") < half, 1)).alias("__near")).filter("__near > 0").drop("__near")
    scatter = rows.filter(outside).join(level, key).groupBy(key).agg((F.median(F.abs(F.col("__y") - F.col("__level"))) * MAD).alias("__scatter"))
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("view"), F.lit(global_bins if n == "global" else local_bins).alias("bins")) for n in NAMES])).alias("v")
    grid = level.join(scatter, key, "left").select(key, "__level", "__scatter", every).select(key, "__level", "__scatter", "v.view", F.explode(F.sequence(F.lit(0), F.col("v.bins") - 1)).alias("bin"))
    filled = grid.join(medians, [key, "view", "bin"], "left")
    w = Window.partitionBy(key, "view").orderBy("bin")
    known = F.when(F.col("m").isNotNull(), F.struct("bin", "m"))
    before, after = F.last(known, True).over(w), F.first(known, True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = filled.withColumns({"__a": before, "__b": after})
    line = F.col("__a.m") + (F.col("__b.m") - F.col("__a.m")) * F.coalesce(F.try_divide(F.col("bin") - F.col("__a.bin"), F.col("__b.bin") - F.col("__a.bin")), F.lit(0.0))
    filled = filled.withColumn("value", F.coalesce("m", line, "__a.m", "__b.m", "__level") - F.col("__level"))
    deepest = F.min(F.when(F.col("view") == "local", F.col("value"))).over(Window.partitionBy(key))
    depth = F.when(deepest < 0, -deepest).when(F.col("__scatter") > 0, F.col("__scatter")).otherwise(1.0)
    return filled.withColumn("__depth", depth).select(key, "view", "bin", (F.col("value") / F.col("__depth")).alias("value"))


def views_of(
    time: np.ndarray, flux: np.ndarray, period: np.ndarray, epoch: np.ndarray, duration: np.ndarray, global_bins: int = 2001, local_bins: int = 201, durations: float = 4.0, bin_width: float = 0.16, mask: float = 1.0
) -> tuple[np.ndarray, np.ndarray]:
    """The views of one series at several signals, as make_views() gives them: (places of the signals that have samples near
    their dip, values), a row of all views' bins, in the order of NAMES, for each. Signals that are not sound have none."""
    y = flux - 1

    def folded(t0: np.ndarray) -> np.ndarray:
        shifted = time - t0[:, None] + p[:, None] / 2
        return shifted - p[:, None] * np.floor(shifted / p[:, None]) - p[:, None] / 2

    with np.errstate(invalid="ignore"):
        sound = np.flatnonzero((period > 0) & (duration > 0) & ~np.isnan(epoch))
    p, e, d = period[sound], epoch[sound], duration[sound]
    half = np.minimum(durations * d, p / 2)
    x, h = folded(e), folded(e + p / 2)
    has = (np.abs(x) < half[:, None]).any(axis=1)
    sound, p, e, d, half, x, h = (a[has] for a in (sound, p, e, d, half, x, h))
    n, sizes = len(sound), np.array([global_bins, *[local_bins] * 4])
    start = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    if not n:
        return sound, np.zeros((0, total))
    odd = np.mod(np.rint((time - e[:, None]) / p[:, None]), 2) == 1
    cells, values = [], []

    def deal(at: np.ndarray, reach: np.ndarray, bins: int, width: np.ndarray, first: np.ndarray | int) -> None:
        step = 2 * reach / bins
        low = np.maximum(np.ceil((at - width / 2 + reach) / step - 0.5), 0).astype(np.int64)
        high = np.minimum(np.floor((at + width / 2 + reach) / step - 0.5), bins - 1).astype(np.int64)
        count = np.maximum(high - low + 1, 0)
        line, sample = np.nonzero(count)
        many = count[line, sample]
        ends = np.cumsum(many)
        bin_ = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many - low[line, sample], many)
        cells.append(np.repeat(line * total + np.broadcast_to(first, at.shape)[line, sample], many) + bin_)
        values.append(np.repeat(y[sample], many))

    local = half[:, None], local_bins, bin_width * d[:, None]
    deal(x, p[:, None] / 2, global_bins, p[:, None] / global_bins, 0)
    deal(x, *local, start[1])
    deal(x, *local, np.where(odd, start[2], start[3]))
    deal(h, *local, start[4])
    cell, value = np.concatenate(cells), np.concatenate(values)
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
    size = np.diff(np.r_[first, len(cell)])
    m = np.full(n * total, np.nan)
    m[cell[first]] = (value[first + (size - 1) // 2] + value[first + size // 2]) / 2
    m = m.reshape(n, total)

    def middle_of(v: np.ndarray, own: np.ndarray) -> np.ndarray:
        ordered, k, line = np.sort(np.where(own, v, np.inf), axis=1), own.sum(axis=1), np.arange(n)
        return np.where(k > 0, (ordered[line, np.maximum(k - 1, 0) // 2] + ordered[line, k // 2]) / 2, np.nan)

    outside = np.abs(x) > mask * d[:, None]
    level = np.nan_to_num(middle_of(np.broadcast_to(y, x.shape), outside), nan=0.0)
    scatter = middle_of(np.abs(y - level[:, None]), outside) * MAD
    out = np.empty((n, total))
    for v, bins in zip(start, sizes, strict=True):
        own, place = m[:, v : v + bins], np.arange(bins)
        known = ~np.isnan(own)
        before = np.maximum.accumulate(np.where(known, place, -1), axis=1)
        after = np.minimum.accumulate(np.where(known, place, bins)[:, ::-1], axis=1)[:, ::-1]
        a, b = (np.take_along_axis(own, np.clip(i, 0, bins - 1), axis=1) for i in (before, after))
        a, b = np.where(before < 0, b, a), np.where(after == bins, a, b)
        gap = after - before
        line = a + (b - a) * np.where((gap > 0) & (before >= 0) & (after < bins), (place - before) / np.maximum(gap, 1), 0.0)
        filled = np.where(known, own, line)
        out[:, v : v + bins] = np.where(np.isnan(filled), level[:, None], filled) - level[:, None]
    deepest = out[:, start[1] : start[1] + local_bins].min(axis=1)
    depth = np.where(deepest < 0, -deepest, np.where(scatter > 0, scatter, 1.0))
    return sound, out / depth[:, None]


def view_places(global_bins: int = 2001, local_bins: int = 201, **_: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the view, bin) of each value in a row of views_of()."""
    sizes = [global_bins, *[local_bins] * 4]
    return np.repeat(np.arange(5, dtype=np.int32), sizes), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])


def as_arrays(views: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, global, local, odd, even, secondary): the views of a series as arrays of float."""
    each = views.groupBy(key, "view").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "value"))), lambda x: x["value"].cast("float")).alias("a"))
    return each.groupBy(key).pivot("view", NAMES).agg(F.first("a"))
