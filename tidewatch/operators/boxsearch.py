"""Box searches over whole period grids: one exchange on the series' key, then a vectorised search of each series.

A group is one series, bounded by how long an instrument looks at one target; what leaves a task is a row a series, or a row
a trial period where the powers themselves are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.operators.series import MAD
from tidewatch.operators.survey import guarded

#: Elements of a block of trial periods by bins, or by samples, at most; and by bins where that leaves 64 periods, so that the
#: arrays stay in the cache and are no new pages each time.
BLOCK, SMALL = 1 << 17, 1 << 14


def period_grid(baseline: float, shortest: float = 0.5, count: int = 2000, share: float = 0.5, usual: float = 27.4) -> np.ndarray:
    """Trial periods, even in their logarithm, from `shortest` to `share` of the baseline (1.5 times the shortest at least).

    From one to the next the last event of a series shifts by baseline * step of log period; a baseline longer than `usual`
    gets as many periods as keep that shift to what `count` of them have over `usual`.
    """

    def longest(b: float) -> float:
        return max(1.5 * shortest, share * b)

    shift = usual * np.log(longest(usual) / shortest) / (count - 1)
    needed = int(np.ceil(baseline * np.log(longest(baseline) / shortest) / shift - 1e-9)) + 1
    return np.geomspace(shortest, longest(baseline), max(count, needed))


def search(time: np.ndarray, flux: np.ndarray, weight: np.ndarray, periods: np.ndarray, durations: Sequence[float], per_duration: int = 4) -> dict[str, np.ndarray]:
    """For each period the box of most signal-to-noise: power, depth, error, n, k (bins), start (bin); power is nan where
    no box dips. Bins are a shortest duration over per_duration wide; running sums over the bins, wrapped once, give every
    box. Ties, to nine digits, go to the shorter box, then the earlier bin. Boxes hold two samples or more, but not all,
    and neither all of the weight nor none.

    With flux about its weighted mean, a box of weight w and sum s has depth -s W / (w (W - w)) of error sqrt(W / (w (W - w))), and
    their ratio is -s times the error: a product of two arrays for all boxes; the rest is worked out for the best ones only.
    """
    width = min(durations) / per_duration
    ks = sorted({round(d / width) for d in durations})
    longest = max(ks)
    out = {c: np.full(len(periods), np.nan) for c in ("power", "depth", "error")} | {c: np.zeros(len(periods), np.int64) for c in ("n", "k", "start")}
    n_all, w_all = len(time), weight.sum()
    if n_all < 3 or not np.isfinite(w_all) or w_all <= 0:
        return out
    pull = weight * (flux - (weight * flux).sum() / w_all)
    even = weight.min() == weight.max()
    # Of samples that weigh the same, the error depends on their number only; 0 where a box does not count.
    share = np.arange(n_all + 1) * (w_all / n_all)
    by_number = np.zeros(n_all + 1)
    by_number[2:n_all] = np.sqrt(w_all / (share[2:n_all] * (w_all - share[2:n_all])))
    turns = np.ceil(periods / width).astype(np.int64)
    order = np.argsort(turns, kind="stable")
    most = max(1, min(256, BLOCK // n_all))
    tiled = {name: np.tile(x, min(most, len(order))) for name, x in (("pull", pull), *(() if even else (("weight", weight),)))}
    at, room = 0, np.empty(0)
    while at < len(order):
        # Periods are sorted by their bins, so that a block wastes few; a block's arrays stay in the cache. A block has a row a bin and
        # a column a period, so that whatever is done for a box length is done to whole arrays, not to short rows.
        bins = int(turns[order[min(at + most, len(order)) - 1]]) + longest
        rows = max(1, SMALL // bins, min(64, BLOCK // bins))
        own = order[at : at + min(rows, most)]
        at += len(own)
        p, t, size = periods[own][:, None], turns[own], len(own)
        least, m, line = int(t.min()), int(t.max()), np.arange(size)
        x = time / p
        np.floor(x, out=x)
        x *= p
        np.subtract(time, x, out=x)
        x /= width
        flat = x.astype(np.int64)  # none is negative
        np.minimum(flat, t[:, None] - 1, out=flat)
        flat += 1
        flat *= size
        flat += line[:, None]
        flat = flat.ravel()
        # The first bins once more behind each period's last one.
        onward = np.arange(longest)[:, None]
        first_bins, behind_last = (onward % t + 1) * size + line, (t + 1 + onward) * size + line

        def running(*values: np.ndarray) -> np.ndarray:
            sums = np.bincount(flat, *values, minlength=(m + longest + 1) * size)
            sums[behind_last] = sums[first_bins]
            sums = sums.reshape(-1, size)
            # Row by row is thrice as fast as np.cumsum down the columns, if rows are not short.
            if size < 32:
                return np.cumsum(sums, axis=0, out=sums)
            for above, here in pairwise(sums):
                here += above
            return sums

        count, pulled = running(), running(tiled["pull"][: len(flat)])
        weighed = None if even else running(tiled["weight"][: len(flat)])
        ahead = np.arange(least, m)[:, None] < t
        if len(room) < len(ks) * m * size:
            room = np.empty(len(ks) * m * size)
        best, winner, powers = np.zeros(size), np.full(size, -1), room[: len(ks) * m * size].reshape(len(ks), m, size)
        for j, k in enumerate(ks):
            n, power = count[k : k + m] - count[:m], np.subtract(pulled[:m], pulled[k : k + m], out=powers[j])
            if even:
                power *= by_number.take(n, mode="clip")
            else:
                w = weighed[k : k + m] - weighed[:m]
                w *= w_all - w
                # Where all weight is on one side, only rounding is left.
                sound = (n >= 2) & (n < n_all) & (w > 1e-9 * w_all * w_all)
                power[:] = np.where(sound, power * np.sqrt(w_all / np.where(sound, w, 1.0)), 0.0)
            power[least:] *= ahead
            if k >= least:
                power[:, k >= t] = 0.0
            top = np.round(power.max(axis=0), 9)
            new = top > best
            best[new], winner[new] = top[new], j
        first = np.zeros(size, np.int64)
        for j, power in enumerate(powers):
            new = winner == j
            if new.any():
                first[new] = (power >= best - 5e-10).argmax(axis=0)[new]
        dips = np.flatnonzero(winner >= 0)
        i, first, j = own[dips], first[dips], winner[dips]
        k = np.array(ks)[j]
        power, n = powers[j, first, dips], count[first + k, dips] - count[first, dips]
        w = n * (w_all / n_all) if even else weighed[first + k, dips] - weighed[first, dips]
        error = np.sqrt(w_all / (w * (w_all - w)))
        out["power"][i], out["error"][i], out["depth"][i] = power, error, power * error
        out["n"][i], out["k"][i], out["start"][i] = n, k, first
    return out


def efficiency(power: np.ndarray, least: int = 10) -> float:
    """The best power above the median one, in robust sigmas."""
    p = power[np.isfinite(power)]
    sigma = MAD * np.median(np.abs(p - np.median(p))) if len(p) >= least else 0.0
    return float((p.max() - np.median(p)) / sigma) if sigma > 0 else np.nan


def contrast(periods: np.ndarray, power: np.ndarray) -> float:
    """The best power over the best more than 10 % away from 1/2, 1, 2 and 3 times its period: the shortest of those equal to nine digits."""
    if not np.isfinite(power).any():
        return np.nan
    top = np.nanargmax(np.round(power, 9))
    apart = np.all([np.abs(periods / (a * periods[top]) - 1) > 0.1 for a in (0.5, 1.0, 2.0, 3.0)], axis=0) & np.isfinite(power)
    return float(power[top] / power[apart].max()) if apart.any() else np.nan


#: Times which a period is one of the same signal.
SAME = np.array([1.0, 1 / 2, 2.0, 1 / 3, 3.0])


def distinct_peaks(periods: np.ndarray, power: np.ndarray, k: int, within: float = 0.01) -> list[int]:
    """Places of the k strongest periods that are different signals: none within a share of another, its half, third,
    double or triple."""
    order = np.argsort(-np.nan_to_num(power, nan=-np.inf), kind="stable")
    order = order[np.isfinite(power[order])]
    taken: list[int] = []
    # Places that an earlier one rules out go all together; what comes first of the others is the next.
    while len(order) and len(taken) < k:
        first, order = int(order[0]), order[1:]
        taken.append(first)
        ratio = periods[order] / periods[first]
        order = order[(np.abs(ratio / SAME[:, None] - 1) >= within).all(axis=0)]
    return taken


def _series(table: pa.Table, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    time, flux = (table.column(c).to_numpy(zero_copy_only=False) for c in ("time", "flux"))
    if weighted:
        error = table.column("flux_err").to_numpy(zero_copy_only=False)
        spread = MAD * np.median(np.abs(flux - np.median(flux)))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = 1 / np.where(error > 0, error, spread) ** 2
        return time, flux, np.where(np.isfinite(weight), weight, 0.0)
    return time, flux, np.full(len(time), 1 / flux.var() if len(flux) and flux.var() > 0 else np.nan)


def grid_of(time: np.ndarray, periods: Sequence[float] | None) -> np.ndarray:
    return np.array(periods, float) if periods is not None else period_grid(float(time.max() - time.min()) if len(time) else 0.0)


def _grouped(series: DataFrame, key: str, weighted: bool, run, schema: str, errors: bool = False) -> DataFrame:
    columns = [key, "time", "flux", *(["flux_err"] if weighted else [])]
    schema = f"`{key}` {dict(series.dtypes)[key]}, {schema}"
    if errors:
        run, schema = guarded(run, schema, key)
    return series.select(*columns).groupBy(key).applyInArrow(run, schema)


def box_search(series: DataFrame, periods: Sequence[float] | None, durations: Sequence[float], per_duration: int = 4, weighted: bool = False, key: str = "target_id") -> DataFrame:
    """(key, period, power, depth, duration, phase0): for each trial period (None: period_grid() of each series' own
    baseline) the box of most signal-to-noise; periods at which nothing dips have no row. weighted: by the inverse
    square of flux_err, or of the robust sigma where it is not positive; else all samples weigh the same."""
    width = min(durations) / per_duration

    def run(table: pa.Table) -> pa.Table:
        time, flux, weight = _series(table, weighted)
        grid = grid_of(time, periods)
        found = search(time, flux, weight, grid, durations, per_duration)
        ok = np.isfinite(found["power"])
        return pa.table({
            key: pa.array([table.column(key)[0].as_py()] * int(ok.sum()), table.schema.field(key).type), "period": grid[ok], "power": found["power"][ok], "depth": found["depth"][ok],
            "duration": found["k"][ok] * width, "phase0": found["start"][ok] * width,
        })

    return _grouped(series, key, weighted, run, "period double, power double, depth double, duration double, phase0 double")


def strongest(time: np.ndarray, flux: np.ndarray, weight: np.ndarray, grid: np.ndarray, durations: Sequence[float], per_duration: int = 4, floor: int = 10) -> tuple[dict[str, float], np.ndarray] | None:
    """The best box over a grid of periods as a signal (see signals()), and how far each sample is from the middle of its
    nearest event; None where nothing dips."""
    f, width = search(time, flux, weight, grid, durations, per_duration), min(durations) / per_duration
    if not np.isfinite(f["power"]).any():
        return None
    i = int(np.argmax(np.round(np.nan_to_num(f["power"], nan=-np.inf), 9)))
    duration = f["k"][i] * width
    epoch = f["start"][i] * width + duration / 2
    shift = time - epoch + grid[i] / 2
    away = np.abs(shift - grid[i] * np.floor(shift / grid[i]) - grid[i] / 2)
    return {
        "period": grid[i], "epoch": epoch, "duration": duration, "depth": f["depth"][i], "depth_err": f["error"][i], "power": f["power"][i],
        "gain": 0.5 * weight[away < duration / 2].sum() * f["depth"][i] ** 2, "sde": efficiency(f["power"], floor), "contrast": contrast(grid, f["power"]),
    }, away


SIGNAL = "round int, period double, epoch double, duration double, depth double, depth_err double, power double, gain double, sde double, contrast double"


def signals(series: DataFrame, periods: Sequence[float] | None, durations: Sequence[float], rounds: int = 1, threshold: float | None = None, least: int = 3, floor: int = 10, per_duration: int = 4, weighted: bool = False, key: str = "target_id", errors: bool = False) -> DataFrame:
    """(key, round, period, epoch, duration, depth, depth_err, power, gain, sde, contrast): the best box of each series, then of what is
    left when one and a half durations to each side of its events are masked, at most `rounds` times.

    A series ends when fewer than `least` samples are left, nothing dips, or sde is below the threshold. Of equal powers the
    shorter period wins. gain is the box's share of the log-likelihood; sde needs `floor` powers. errors: a column error more,
    and a row that says so for a series whose search raises, instead of the end of the job.
    """

    def found_in(table: pa.Table) -> Iterator[dict]:
        time, flux, weight = _series(table, weighted)
        for number in range(1, rounds + 1):
            if len(time) < least:
                return
            if not weighted:
                weight = np.full(len(time), 1 / flux.var() if flux.var() > 0 else np.nan)
            best = strongest(time, flux, weight, grid_of(time, periods), durations, per_duration, floor)
            if best is None or threshold is not None and not best[0]["sde"] >= threshold:
                return
            found, away = best
            yield {"round": number, **found}
            keep = away > 1.5 * found["duration"]
            time, flux, weight = time[keep], flux[keep], weight[keep]

    names = [x.split()[0] for x in SIGNAL.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = list(found_in(table))
        columns = {c: pa.array([None if r[c] != r[c] else r[c] for r in rows], pa.int32() if c == "round" else pa.float64()) for c in names}
        return pa.table({key: pa.array([table.column(key)[0].as_py()] * len(rows), table.schema.field(key).type), **columns})

    return _grouped(series, key, weighted, run, SIGNAL, errors)
