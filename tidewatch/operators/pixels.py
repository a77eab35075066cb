"""Where on an image a dip comes from: difference images of pixel cubes, their centroids, and verdicts over several cubes.

A cube is a table with a row a cadence: key columns, time, and `pixels`, the image row after row. Only sums over an image
leave the first step; a dip's offset and its covariance then come from sums over events, so everything is a grouping by
event, then by cube, and no cube is held anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import epoch_number, phase

#: Coefficients of a rational fit of erfc, good to 1.2e-7 of its value everywhere.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _log_erfc(x: Column) -> Column:
    """log(erfc(x)) for x >= 0."""
    t = 1 / (1 + x / 2)
    series: Column = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = series * t + c
    return F.log(t) - x * x + series


def sigma_of_log_p(log_p: Column) -> Column:
    """The s with P(|z| > s) = exp(log_p) for a standard normal z, also where exp(log_p) is 0 in floating point; 0 for
    log_p >= 0, null for null. Newton's steps on the logarithm."""
    start = F.sqrt(F.greatest(-2 * log_p - F.log(F.greatest(-2 * log_p, F.lit(1.0))), F.lit(0.25)))

    def step(s: Column, _: Column) -> Column:
        x = s / math.sqrt(2)
        value = _log_erfc(x)
        slope = -math.sqrt(2 / math.pi) * F.exp(-x * x - value)
        return F.greatest(s - (value - log_p) / slope, F.lit(0.0))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step)
    return F.when(log_p >= 0, F.lit(0.0)).when(log_p.isNotNull() & ~F.isnan(log_p), found)


def image_sums(cubes: DataFrame, width: int, x: Column | float, y: Column | float, radius: float) -> DataFrame:
    """cubes without pixels, with s (sum of the pixels whose centre is within radius of (x, y)), sx and sy (sums of pixel
    times column, times row). Rows with a missing pixel there have null; a window without pixels has 0. Columns and rows
    count from 0."""
    x, y = (c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y))
    numbered = F.transform("pixels", lambda p, i: F.struct(p.cast("double").alias("p"), (i % width).cast("double").alias("c"), F.floor(i / width).cast("double").alias("r")))
    inside = F.filter(numbered, lambda q: (q["c"] - x) * (q["c"] - x) + (q["r"] - y) * (q["r"] - y) <= radius * radius)
    total = lambda f: F.aggregate("__w", F.lit(0.0), lambda a, q: a + f(q))  # noqa: E731  null if a pixel is
    rows = cubes.withColumn("__w", inside)
    rows = rows.withColumns({"s": total(lambda q: q["p"]), "sx": total(lambda q: q["p"] * q["c"]), "sy": total(lambda q: q["p"] * q["r"])}).drop("__w", "pixels")
    sound = F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") < float("inf"))
    return rows.withColumns({c: F.when(sound, F.col(c)) for c in ("s", "sx", "sy")})


def difference_events(sums: DataFrame, by: Sequence[str], inner: float = 0.8, near: float = 1.0, far: float = 2.5) -> DataFrame:
    """(by, event, n_in, n_out, d, dx, dy, o, ox, oy): for each event the mean image sums out of the dip (o...) and their
    excess over those in it (d...). sums: image_sums() with period, epoch and duration. In: within `inner` half durations
    of the middle; out: `near` to `far` whole durations from it. Events need both."""
    period = F.when(F.col("period") > 0, F.col("period"))
    away = F.abs(phase(F.col("time"), period, F.col("epoch")))
    inside, outside = away < inner * F.col("duration") / 2, (away >= near * F.col("duration")) & (away <= far * F.col("duration"))
    usable = sums.filter("s IS NOT NULL AND period > 0 AND duration > 0").withColumns({"__in": inside, "__out": outside, "event": epoch_number(F.col("time"), period, F.col("epoch"))})
    means = [F.avg(F.when(F.col(side), F.col(c))).alias(f"{name}{c[1:]}") for name, side in (("i", "__in"), ("o", "__out")) for c in ("s", "sx", "sy")]
    counts = [F.count(F.when(F.col(side), 1)).alias(n) for n, side in (("n_in", "__in"), ("n_out", "__out"))]
    events = usable.filter("__in OR __out").groupBy(*by, "event").agg(*counts, *means).filter("n_in > 0 AND n_out > 0")
    return events.select(*by, "event", "n_in", "n_out", *[(F.col(f"o{c}") - F.col(f"i{c}")).alias(f"d{c}") for c in ("", "x", "y")], "o", "ox", "oy")


def effective_units(n_in: Column, n_out: Column) -> Column:
    """An aggregate over events: how many equal units would know their variance as well as means of n_in and n_out cadences
    do (Welch and Satterthwaite), 3 at least."""
    total = F.sum(1 / n_in + 1 / n_out)
    spread = F.sum(sum(F.when(n > 1, 1 / (n * n * (n - 1.0))).otherwise(0.0) for n in (n_in, n_out)))
    return F.when(spread > 0, F.greatest(total * total / spread + 1, F.lit(3.0))).otherwise(F.lit(3.0))


def _log_p_of(x: Column, y: Column, xx: Column, xy: Column, yy: Column, n: Column) -> Column:
    """Hotelling: log of the chance of a vector as far from 0, given its covariance from the scatter of n events."""
    distance = F.try_divide(x * x * yy - 2 * x * y * xy + y * y * xx, xx * yy - xy * xy)
    return -(n - 2) / 2 * F.log1p(F.greatest(distance, F.lit(0.0)) / (n - 1))


def centroid_test(events: DataFrame, by: Sequence[str], x: float | None = None, y: float | None = None, least_snr: float = 3.0, sigma: float = 3.0, shift: float = 0.2) -> DataFrame:
    """One row a cube: by, status, significant, n_events, units, depth, snr, x and y (centroid of the difference image), dx
    and dy (its offset from (x, y), or from the centroid out of the dip where they are not given), xx, xy, yy (covariance of
    the offset), log_p, offset_sigma, distance.

    events: difference_events(). The covariance is that of the events' own influence on the offset, so it holds whatever
    scatters from event to event; it needs three events. status: 'few_events', 'weak' (the dip is not in the difference image at
    least_snr, or takes no light), else 'ok'. significant: ok, and off by `sigma` and by `shift` pixels at least. A cube
    without an event that has both sides has no row.
    """
    own = Window.partitionBy(*by)
    mean = {c: F.avg(c).over(own) for c in ("d", "dx", "dy", "o", "ox", "oy")}
    rows = events.withColumns({f"m_{c}": v for c, v in mean.items()})
    rows = rows.withColumns({f"t{a}": F.when(F.col("m_d") > 0, F.col(f"m_d{a}") / F.col("m_d")) for a in "xy"} | {f"p{a}": F.when(F.col("m_o") > 0, F.col(f"m_o{a}") / F.col("m_o")) for a in "xy"})
    given = {"x": x, "y": y}
    for a in "xy":
        moved = (F.col(f"d{a}") - F.col(f"t{a}") * F.col("d")) / F.col("m_d")
        still = F.lit(0.0) if given[a] is not None else (F.col(f"o{a}") - F.col(f"p{a}") * F.col("o")) / F.col("m_o")
        rows = rows.withColumn(f"u{a}", moved - still)
    n = F.count("*")
    product = lambda a, b: (F.sum(F.col(a) * F.col(b)) / (n * (n - 1.0)))
    out = rows.groupBy(*by).agg(
        n.alias("n_events"), effective_units(F.col("n_in"), F.col("n_out")).alias("units"), F.try_divide(F.first("m_d"), F.first("m_o")).alias("depth"),
        F.try_divide(F.first("m_d"), F.stddev_samp("d") / F.sqrt(n)).alias("snr"), F.first("tx").alias("x"), F.first("ty").alias("y"),
        F.first(F.col("tx") - (F.lit(float(x)) if x is not None else F.col("px"))).alias("dx"), F.first(F.col("ty") - (F.lit(float(y)) if y is not None else F.col("py"))).alias("dy"),
        *[F.when(n > 2, product(f"u{a}", f"u{b}")).alias(a + b) for a, b in ("xx", "xy", "yy")],
    )
    out = out.withColumn("log_p", _log_p_of(*[F.col(c) for c in ("dx", "dy", "xx", "xy", "yy", "n_events")]))
    out = out.withColumns({"offset_sigma": sigma_of_log_p(F.col("log_p")), "distance": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))})
    status = F.when(F.col("n_events") < 3, "few_events").when(F.coalesce(F.col("snr") >= least_snr, F.lit(False)) & F.col("dx").isNotNull(), "ok").otherwise("weak")
    out = out.withColumn("status", status)
    return out.withColumn("significant", F.coalesce((F.col("status") == "ok") & (F.col("offset_sigma") >= sigma) & (F.col("distance") >= shift), F.lit(False)))


def combined_tests(tests: DataFrame, by: Sequence[str], radius: float = 5.0, sigma: float = 3.0, shift: float = 0.2) -> DataFrame:
    """One row a star from centroid_test() rows of several cubes whose axes agree (turned onto the sky before): by, n_cubes,
    n_placed, snr, dx, dy, xx, xy, yy, log_p, offset_sigma, distance, significant.

    A cube is placed if its status is 'ok' and its offset within radius. The offset is the mean of the placed ones, each
    weighted by the inverse of its covariance. Its significance is not taken from those weights, which are too sure of
    themselves where a covariance is known from few events: each offset is made a normal deviate of its own p-value in its
    own direction, and their sum over the root of their number is read as one. snr adds in squares over all cubes. Stars
    without a placed cube have null offsets and are not significant.
    """
    placed = (F.col("status") == "ok") & (F.col("distance") <= radius) & F.col("log_p").isNotNull()
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    weight = {"wxx": F.col("yy") / det, "wxy": -F.col("xy") / det, "wyy": F.col("xx") / det}
    # The offset in units of its covariance's Cholesky factor, then as long as a deviate of its p-value.
    root = F.sqrt("xx")
    white = {"ax": F.col("dx") / root, "ay": (F.col("dy") - F.col("xy") / F.col("xx") * F.col("dx")) / F.sqrt(det / F.col("xx"))}
    rows = tests.withColumns({c: F.when(placed & (det > 0), v) for c, v in (weight | white).items()})
    length = F.sqrt(-2 * F.col("log_p")) / F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay"))
    rows = rows.withColumns({"zx": F.when(F.col("log_p") < 0, F.col("ax") * length).otherwise(F.col("ax") * 0), "zy": F.when(F.col("log_p") < 0, F.col("ay") * length).otherwise(F.col("ay") * 0)})
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n_cubes"), F.count("ax").alias("n_placed"), F.sqrt(F.sum(F.col("snr") * F.col("snr"))).alias("snr"), *[F.sum(c).alias(c) for c in ("wxx", "wxy", "wyy", "zx", "zy")],
        F.sum(F.col("wxx") * F.col("dx") + F.col("wxy") * F.col("dy")).alias("bx"), F.sum(F.col("wxy") * F.col("dx") + F.col("wyy") * F.col("dy")).alias("by"),
    )
    whole = F.col("wxx") * F.col("wyy") - F.col("wxy") * F.col("wxy")
    out = out.withColumns({
        "dx": (F.col("wyy") * F.col("bx") - F.col("wxy") * F.col("by")) / whole, "dy": (F.col("wxx") * F.col("by") - F.col("wxy") * F.col("bx")) / whole,
        "xx": F.col("wyy") / whole, "xy": -F.col("wxy") / whole, "yy": F.col("wxx") / whole, "log_p": -(F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy")) / (2 * F.col("n_placed")),
    })
    out = out.withColumns({"offset_sigma": sigma_of_log_p(F.col("log_p")), "distance": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))})
    good = F.coalesce((F.col("offset_sigma") >= sigma) & (F.col("distance") >= shift), F.lit(False))
    return out.select(*by, "n_cubes", "n_placed", "snr", "dx", "dy", "xx", "xy", "yy", "log_p", "offset_sigma", "distance", good.alias("significant"))
