"""The feature vector of every series at its best signal, and searches repeated with signals masked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import physics as X
from tidewatch.operators import boxsearch
from tidewatch.operators.series import MAD

#: The published names of the features, in the published order.
FEATURES = [
    "bls_sde",
    "bls_depth_snr",
    "bls_depth_over_scatter",
    "delta_loglike",
    "power_contrast",
    "log_depth",
    "bls_duration",
    "duration_over_period",
    "log_duration_ratio",
    "log_period",
    "n_transits",
    "min_points_per_transit",
    "odd_even_sigma",
    "secondary_sigma",
    "half_period_depth_ratio",
    "flat_bottom_fraction",
    "harmonic_delta_loglike",
    "harmonic_amp_over_depth",
    "red_noise_beta",
    "log_scatter",
    "max_single_event_fraction",
    "flux_skew",
    "clipped_fraction",
]


def flat_bottom(away: np.ndarray, flux: np.ndarray, duration: float, shapes: int = 20) -> float:
    """Of `shapes` trapezoids whose floor is 0 to 0.95 of the box, the one that leaves the least squares about 1 within one
    and a half durations, at its best depth; nan with fewer than 8 samples there. away: distance from the middle of the dip."""
    near = away < 1.5 * duration
    if near.sum() < 8:
        return np.nan
    floors = np.round(0.95 * np.arange(shapes) / (shapes - 1), 4)
    shape = np.clip((duration / 2 - away[near]) / np.maximum(duration / 2 * (1 - floors[:, None]), 1e-6), 0.0, 1.0)
    squares = (shape * shape).sum(axis=1)
    if not squares.any():
        return np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(squares > 0, (shape @ (flux[near] - 1)) ** 2 / squares, -np.inf)
    return float(floors[np.argmax(np.round(gain, 12))])


def _median(values: np.ndarray) -> float:
    """np.median of a few values, none missing, without what it does besides."""
    ranked, half = np.sort(values), len(values) // 2
    return float(ranked[half]) if len(values) % 2 else float((ranked[half - 1] + ranked[half]) / 2)


def _scatter(values: np.ndarray) -> float:
    return float(MAD * _median(np.abs(values - _median(values)))) if len(values) else np.nan


def _red_noise(time: np.ndarray, flux: np.ndarray, width: float) -> float:
    """Population deviation of means of bins of `width` with two samples or more, over the robust sigma of the samples by the
    root of their mean count; nan with fewer than 20 samples or 4 bins."""
    scatter = _scatter(flux)
    if len(flux) < 20 or not scatter > 0:
        return np.nan
    bins = np.floor((time - time.min()) / width).astype(np.int64)
    _, bins = np.unique(bins, return_inverse=True)
    count = np.bincount(bins)
    full = count >= 2
    if full.sum() < 4:
        return np.nan
    return float((np.bincount(bins, flux)[full] / count[full]).std() / (scatter / np.sqrt(count[full].mean())))


def _birge(depth: np.ndarray, weight: float, groups: list[np.ndarray]) -> float:
    """Root of chi-square over degrees of freedom of depths about the mean of each group of them (depth and counts as
    weights in units of `weight`); nan below two degrees."""
    chi2, freedom = 0.0, 0
    for own in groups:
        d, n = depth[0][own], depth[1][own]
        if len(d):
            chi2 += float(weight * (n * (d - (n * d).sum() / n.sum()) ** 2).sum())
            freedom += len(d) - 1
    return float(np.sqrt(chi2 / freedom)) if freedom >= 2 else np.nan


#: What measured() gives, beside n_transits and min_points_per_transit.
MEASURES = [
    "scatter", "n", "base", "main", "main_error", "second", "second_error", "half", "amplitude", "flux_skew", "delta_loglike", "max_single_event_fraction", "odd_even", "birge", "late_birge", "red_noise_beta",
    "wide_beta", "flat_bottom_fraction",
]


def measured(time: np.ndarray, flux: np.ndarray, period: float, epoch: float, duration: float, depth: float) -> dict[str, float]:
    """MEASURES of one series (in order of time, none missing) at a signal; nan where something cannot be measured."""
    out = dict.fromkeys([*MEASURES, "n_transits", "min_points_per_transit"], np.nan)
    scatter, n = _scatter(flux), len(flux)
    out |= {"scatter": scatter, "n": n}
    if not n:
        return out
    weight = 1 / scatter**2 if scatter > 0 else np.nan
    cadence = _median(np.diff(time)) if n > 1 else 0.0

    def folded(p: float, t0: float) -> np.ndarray:
        shifted = time - t0 + p / 2
        return shifted - p * np.floor(shifted / p) - p / 2

    x, h = folded(period, epoch), folded(period, epoch + period / 2)
    inside, late = np.abs(x) < duration / 2, np.abs(h) < duration / 2

    def box(of: np.ndarray, among: np.ndarray, name: str) -> None:
        a, b = flux[among & of], flux[among & ~of]
        if len(a) and len(b):
            out[name] = float(b.mean() - a.mean())
            if f"{name}_error" in out:
                out[f"{name}_error"] = float(scatter * np.sqrt(1 / len(a) + 1 / len(b)))

    everywhere = np.ones(n, bool)
    box(inside, everywhere, "main")
    box(late, ~inside, "second")
    box(np.abs(folded(period / 2, epoch)) < duration / 2, everywhere, "half")
    angle = x / period * (2 * np.pi)
    out["amplitude"] = float(np.hypot(2 * ((flux - 1) * np.cos(angle)).mean(), 2 * ((flux - 1) * np.sin(angle)).mean()))
    z = flux - flux.mean()
    spread = (z * z).mean()
    out["flux_skew"] = float((z**3).mean() / spread**1.5) if spread > 0 else np.nan
    outside = flux[~inside & ~late]
    base = outside.mean() if len(outside) else np.nan
    out["base"] = float(base)

    def events(of: np.ndarray, t0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number, place = np.unique(np.rint((time[of] - t0) / period), return_inverse=True)
        count = np.bincount(place, minlength=len(number)).astype(float)
        return number, np.stack([base - np.bincount(place, flux[of], len(number)) / count, count]) if len(number) else np.zeros((2, 0)), place

    number, depths, place = events(inside, epoch)
    if len(number):
        y = flux[inside] - 1
        gain = np.bincount(place, weight * (y * y - (y + depth) ** 2) / 2, len(number))
        out |= {"n_transits": len(number), "min_points_per_transit": depths[1].min(), "delta_loglike": gain.sum()}
        out["max_single_event_fraction"] = np.abs(gain).max() / np.abs(gain).sum() if np.abs(gain).sum() > 0 else np.nan
        odd = number % 2 == 1
        if odd.any() and not odd.all():
            (a, wa), (b, wb) = (((depths[0][g] * depths[1][g]).sum() / depths[1][g].sum(), weight * depths[1][g].sum()) for g in (odd, ~odd))
            out["odd_even"] = abs(a - b) / np.sqrt(1 / wa + 1 / wb)
        out["birge"] = _birge(depths, weight, [odd, ~odd])
    number, depths, _ = events(late, epoch + period / 2)
    if len(number):
        out["late_birge"] = _birge(depths, weight, [np.ones(len(number), bool)])
    width = max(duration, 3 * cadence)
    wide = (np.abs(x) >= duration) & (np.abs(h) >= duration)
    out |= {"red_noise_beta": _red_noise(time[~inside], flux[~inside], width), "wide_beta": _red_noise(time[wide], flux[wide], width), "flat_bottom_fraction": flat_bottom(np.abs(x), flux, duration)}
    return out


def _samples(series: DataFrame, key: str) -> DataFrame:
    clipped = F.coalesce(F.col("clipped").cast("boolean"), F.lit(False)) if "clipped" in series.columns else F.lit(False)
    star = [F.col(c).cast("double").alias(c) if c in series.columns else F.lit(None).cast("double").alias(c) for c in ("teff", "density")]
    return series.select(key, F.col("time").cast("double").alias("time"), F.col("flux").cast("double").alias("flux"), clipped.alias("clipped"), *star)


#: A signal as measured() and the features need it.
SIGNAL = ["period", "epoch", "duration", "depth", "bls_sde", "power_contrast"]
NAMES = ["teff", "density", "clipped_fraction", "n_transits", "min_points_per_transit", *MEASURES]


def _row(rows: pa.Table, key: str, signal: Callable[[np.ndarray, np.ndarray], dict[str, float] | None]) -> pa.Table:
    """SIGNAL and NAMES of one series as one array, whose signal comes of its finite samples (clipped ones too) in order of time;
    no row without one. Rows of a table each with dozens of columns would take longer to read than a series to measure."""
    found = None
    if rows.num_rows:
        time, flux, out_of = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("time", "flux", "clipped"))
        out_of = out_of.astype(bool)
        order = np.argsort(time, kind="stable")
        order = order[np.isfinite(time[order]) & np.isfinite(flux[order])]
        found = signal(time[order], flux[order])
    if found is None:
        return pa.table({key: rows.column(key).slice(0, 0), "made": pa.array([], pa.list_(pa.float64()))})
    made = {c: rows.column(c).drop_null()[0].as_py() if rows.column(c).null_count < rows.num_rows else None for c in ("teff", "density")} | {"clipped_fraction": float(out_of.mean())}
    order = order[~out_of[order]]
    made |= found | measured(time[order], flux[order], *(found[c] for c in ("period", "epoch", "duration", "depth")))
    values = [None if made[c] is None or made[c] != made[c] else float(made[c]) for c in [*SIGNAL, *NAMES]]
    return pa.table({key: rows.column(key).slice(0, 1), "made": pa.array([values], pa.list_(pa.float64()))})


def _schema(series: DataFrame, key: str) -> str:
    return f"`{key}` {dict(series.dtypes)[key]}, made array<double>"


def _features(out: DataFrame, key: str) -> DataFrame:
    out = out.select(key, *[F.get("made", F.lit(i)).alias(c) for i, c in enumerate([*SIGNAL, *NAMES])])
    p, d, s = F.col("period"), F.col("duration"), F.when(F.col("scatter") > 0, F.col("scatter"))
    red = X.inflation(F.col("wide_beta"))
    allowance = F.coalesce(X.largest_occultation(p, F.col("teff"), F.col("density")), F.lit(0.0)) * F.greatest("depth", F.lit(0.0))
    values = {
        "bls_depth_snr": F.try_divide(F.col("main"), "main_error"), "bls_depth_over_scatter": F.col("depth") / s, "log_depth": F.log10(F.greatest("depth", F.lit(1e-8))),
        "bls_duration": d, "duration_over_period": d / p, "log_duration_ratio": F.log10(d / X.central_duration(p, F.lit(X.SUN_DENSITY))), "log_period": F.log10(p),
        "n_transits": F.col("n_transits").cast("long"), "min_points_per_transit": F.col("min_points_per_transit").cast("long"),
        "odd_even_sigma": F.col("odd_even") / F.greatest(red, X.inflation(F.col("birge"))),
        "secondary_sigma": F.try_divide(X.beyond_allowance(F.col("second"), allowance), "second_error") / F.greatest(red, X.inflation(F.col("late_birge"))),
        "half_period_depth_ratio": F.try_divide(F.col("half"), "depth"), "harmonic_amp_over_depth": F.try_divide(F.col("amplitude"), "depth"),
        "harmonic_delta_loglike": F.col("n") * F.col("amplitude") * F.col("amplitude") / 4 / (s * s), "log_scatter": F.log10(s),
    }
    return out.select(key, "period", "epoch", "duration", "depth", *[values.get(f, F.col(f)).alias(f) for f in FEATURES])


def extract(series: DataFrame, signals: DataFrame, key: str = "target_id") -> DataFrame:
    """One row a series with a dip: key, period, epoch, duration, depth and FEATURES.

    series: normalised, perhaps with `clipped` (samples that count in clipped_fraction only), teff and density (of the star, for
    the deepest occultation a planet could show). signals: a row a series of boxsearch.signals(). Series without a dip have
    no row; samples whose time or flux is missing or not finite do not count; what cannot be measured is null. Odd and even
    events are compared under the scatter within each parity, the dip at half the period under the scatter of its own
    events, and both under red noise outside all of them.

    Samples and signals meet once, in a group of one series, which is measured in one pass; the rest is expressions over
    the row that comes of it.
    """
    best = signals.filter("round = 1").select(F.col(key).alias("__key"), "period", "epoch", "duration", "depth", F.col("sde").alias("bls_sde"), F.col("contrast").alias("power_contrast"))

    def run(rows: pa.Table, signal: pa.Table) -> pa.Table:
        return _row(rows, key, lambda *_: {c: signal.column(c)[0].as_py() for c in SIGNAL} if signal.num_rows else None)

    return _features(_samples(series, key).groupBy(key).cogroup(best.groupBy("__key")).applyInArrow(run, _schema(series, key)), key)


def searched(series: DataFrame, periods: Sequence[float] | None, durations: Sequence[float], floor: int = 10, least: int = 3, per_duration: int = 4, key: str = "target_id") -> DataFrame:
    """extract() of the strongest box of each series, as boxsearch.signals() finds it: searched and measured in one group, so that
    samples travel and are grouped once."""

    def best(time: np.ndarray, flux: np.ndarray) -> dict[str, float] | None:
        if len(time) < least:
            return None
        weight = np.full(len(time), 1 / flux.var() if flux.var() > 0 else np.nan)
        grid = boxsearch.grid_of(time, periods)
        found = boxsearch.strongest(time, flux, weight, grid, durations, per_duration, floor)
        return found and found[0] | {"bls_sde": found[0]["sde"], "power_contrast": found[0]["contrast"]}

    return _features(_samples(series, key).groupBy(key).applyInArrow(lambda rows: _row(rows, key, best), _schema(series, key)), key)


def iterative_search(series: DataFrame, periods: Sequence[float] | None, durations: Sequence[float], threshold: float = 5.5, rounds: int = 3, least: int = 200, floor: int = 10, key: str = "target_id") -> DataFrame:
    """(key, round, period, epoch, duration, depth, sde): search, note the signal if its efficiency reaches the threshold,
    mask one and a half durations to each side, and search what is left: at most `rounds` times, series by series, while
    `least` samples are left. All rounds of a series are one pass over it; the plan has one exchange."""
    found = boxsearch.signals(series, periods, durations, rounds=rounds, threshold=threshold, least=least, floor=floor, key=key)
    return found.select(key, "round", "period", "epoch", "duration", "depth", "sde")
