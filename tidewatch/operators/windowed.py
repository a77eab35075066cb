"""A box search of series too long for one period grid: candidates from the densest stretch, chosen on the whole series.

A task holds one series. A grid over a baseline B needs periods in proportion to B; here only the stretch gets a grid, and
each of a few candidates a short, fine one over the whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.operators import dips
from tidewatch.operators.boxsearch import contrast, distinct_peaks, efficiency, period_grid, search


def densest(time: np.ndarray, length: float) -> tuple[float, float]:
    """Start and end of the stretch of `length`, beginning at a sample, that holds most samples; the first on ties."""
    count = np.searchsorted(time, time + length, "right") - np.arange(len(time))
    start = float(time[int(np.argmax(count))])
    return start, start + length


#: Elements of a block of trials by samples.
BLOCK = 1 << 17


def without_strongest(time: np.ndarray, flux: np.ndarray, weight: np.ndarray, period: float, epoch: float, duration: float) -> tuple[float, int]:
    """Signal-to-noise of the mean depth with the event that adds most to it left out, and the number of events with samples;
    nan with fewer than two. The baseline leaves out the boxes at phase 0 and at half the period."""
    score, events = all_without_strongest(time, flux, weight, *(np.array([x]) for x in (period, epoch, duration)))
    return float(score[0]), int(events[0])


def all_without_strongest(time: np.ndarray, flux: np.ndarray, weight: np.ndarray, periods: np.ndarray, epochs: np.ndarray, durations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """without_strongest() of many trials, blocks of them at a time."""
    pieces = range(0, len(periods), max(1, BLOCK // max(1, len(time))))
    made = [_without_strongest(time, flux, weight, *(x[at : at + pieces.step, None] for x in (periods, epochs, durations))) for at in pieces]
    return tuple(np.concatenate([m[i] for m in made]) if made else np.zeros(0) for i in (0, 1))


def _without_strongest(time: np.ndarray, flux: np.ndarray, weight: np.ndarray, p: np.ndarray, epoch: np.ndarray, duration: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = len(p)
    shift = time - epoch
    x = shift + p / 2
    x = np.abs(x - p * np.floor(x / p) - p / 2)
    inside = x < duration / 2
    outside = ~(inside | (np.abs(x - p / 2) < duration / 2))
    line, sample = np.nonzero(inside)
    # Samples in boxes come by trial, then time: an event is a run of one number.
    number = np.rint(shift[line, sample] / p[line, 0])
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (number[1:] != number[:-1])
    place, of = np.cumsum(new) - 1, line[new]
    events = np.bincount(of, minlength=rows)
    free = np.where(outside, weight, 0.0)
    level = free.sum(axis=1)
    base = (free * flux).sum(axis=1) / np.where(level > 0, level, 1.0)
    w = np.bincount(place, weight[sample], len(of))
    d = np.bincount(place, weight[sample] * (base[line] - flux[sample]), len(of))
    left = np.bincount(of, w, rows)[of] - w
    with np.errstate(divide="ignore", invalid="ignore"):
        snr = np.where(left > 0, (np.bincount(of, d, rows)[of] - d) / np.sqrt(left), np.inf)
    score = np.full(rows, np.inf)
    np.minimum.at(score, of, snr)
    return np.where((events >= 2) & (level > 0) & np.isfinite(score), score, np.nan), events


def windowed(time: np.ndarray, flux: np.ndarray, weight: np.ndarray, durations: Sequence[float], window: float, candidates: int = 10, grid: Sequence[float] | None = None, pairs: dips.Rules | None = None, shortest_pair: float = 2.0, per_duration: int = 4) -> dict | None:
    """The strongest periodic dip of one series (in order of time), or None where nothing dips.

    The stretch of `window` is searched on its grid (or on `grid`). Of its distinct peaks the `candidates` with most
    signal-to-noise without their strongest event, with half and double their periods, are searched again on the whole series:
    within half a duration over the window, and two steps of the window's grid, in steps as fine as a grid over the whole
    series has. With `pairs`, two like dips anywhere also propose the periods that nothing contradicts (dips.py); of one
    pair's, that with most events on samples stands for it. The trial of most signal-to-noise without its strongest event wins.
    """
    start, stop = densest(time, window)
    own = (time >= start) & (time <= stop)
    t, f, w = time[own], flux[own], weight[own]
    coarse = np.asarray(grid, float) if grid is not None else period_grid(float(t[-1] - t[0]))
    width = min(durations) / per_duration
    found = search(t, f, w, coarse, durations, per_duration)
    power = found["power"]
    if not np.isfinite(power).any():
        return None
    step = float(np.log(coarse[1] / coarse[0])) if len(coarse) > 1 else 0.01
    whole = period_grid(float(time[-1] - time[0]))
    fine = min(float(np.log(whole[1] / whole[0])), step) if grid is None else step
    longest = float(max(whole[-1], coarse.max()))

    def at(result: dict, i: int | slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Epoch and duration of the best box of a trial period, or of several."""
        duration = result["k"][i] * width
        return result["start"][i] * width + duration / 2, duration

    def refined(trials: list[tuple[float, float]]) -> list[tuple[float, float, float, int] | None]:
        """(score, period, centre, events) of the best period about the centre of each trial (period, duration), or None: one
        search of all their periods."""
        near = []
        for centre, duration in trials:
            n = int(np.ceil(max(duration / 2 / window, 2 * step) / fine))
            periods = centre * np.exp(fine * np.arange(-n, n + 1))
            near.append(periods[(periods >= coarse.min()) & (periods <= longest)])
        every = np.concatenate(near) if near else np.zeros(0)
        if not len(every):
            return [None] * len(trials)
        result = search(time, flux, weight, every, durations, per_duration)
        scores, events = all_without_strongest(time, flux, weight, every, *at(result, slice(None)))
        scores = np.where(np.isfinite(result["power"]) & np.isfinite(scores), scores, -np.inf)
        out, first = [], 0
        for (centre, _), own in zip(trials, near, strict=True):
            i = first + int(np.argmax(scores[first : first + len(own)])) if len(own) else 0
            out.append((float(scores[i]), float(every[i]), centre, int(events[i])) if len(own) and np.isfinite(scores[i]) else None)
            first += len(own)
        return out

    padded = np.concatenate([[-np.inf], np.nan_to_num(power, nan=-np.inf), [-np.inf]])
    local = (padded[1:-1] >= padded[:-2]) & (padded[1:-1] >= padded[2:])
    peaks = np.array(distinct_peaks(coarse, np.where(local, power, np.nan), len(coarse)), int)
    epochs, lengths = at(found, peaks)
    scored = zip(all_without_strongest(t, f, w, coarse[peaks], epochs, lengths)[0].tolist(), peaks.tolist(), strict=True)
    ranked = sorted([x for x in scored if np.isfinite(x[0])], key=lambda x: (-x[0], x[1]))[:candidates]
    trials = [(float(coarse[i]) * a, float(at(found, i)[1])) for _, i in ranked for a in (1.0, 0.5, 2.0)]
    alone = len(trials)
    of_pairs: list[range] = []
    if pairs is not None and len(time) >= 20:
        s = dips.Series(time, flux)
        events = sorted([e for e in (dips.found_dips(s, durations, pairs) if s.sigma > 0 else []) if not e["ramp"]], key=lambda e: e["time"])
        for j, b in enumerate(events):
            for a in events[:j]:
                if dips.alike(a, b):
                    length = (a["duration"] + b["duration"]) / 2
                    most = int((b["time"] - a["time"]) // shortest_pair)
                    own = [(p, length) for _, p in dips.allowed_periods(s, a["time"], b["time"], length, (a["depth"] + b["depth"]) / 2, shortest_pair, most, pairs)]
                    of_pairs.append(range(len(trials), len(trials) + len(own)))
                    trials += own
    results = refined(trials)
    tried = [r for r in results[:alone] if r]
    for own in of_pairs:
        of_pair = [r for r in (results[i] for i in own) if r]
        if of_pair:
            events_seen = max(r[3] for r in of_pair)
            alike = [r for r in of_pair if r[3] == events_seen]
            tried.append(min(alike, key=lambda r: r[1]) if events_seen <= 2 else max(alike, key=lambda r: r[0]))
    if tried:
        score, period, _, events = max(tried, key=lambda r: (r[0], -r[1]))
        result, i = search(time, flux, weight, np.array([period]), durations, per_duration), 0
    else:
        i, result, score, events = int(np.argmax(np.round(np.nan_to_num(power, nan=-np.inf), 9))), found, np.nan, 0
        period = float(coarse[i])
    epoch, duration = at(result, i)
    return {
        "period": period, "epoch": float(epoch), "duration": float(duration), "depth": float(result["depth"][i]), "power": float(result["power"][i]), "score": score, "n_events": events, "sde": efficiency(power, min(10, len(coarse))),
        "contrast": contrast(coarse, power), "window_start": start, "window_end": stop,
    }


SIGNAL = "period double, epoch double, duration double, depth double, power double, score double, n_events int, sde double, contrast double, window_start double, window_end double"


def windowed_search(series: DataFrame, durations: Sequence[float], window: float, candidates: int = 10, grid: Sequence[float] | None = None, pairs: dips.Rules | None = None, least: int = 3, key: str = "target_id") -> DataFrame:
    """(key, period, epoch, duration, depth, power, score, n_events, sde, contrast, window_start, window_end): windowed() for
    each series. Samples that are missing or not finite do not count; series of fewer than `least`, without variance or
    without a dip have no row; score is null, and the signal that of the window, where no trial has two events."""
    names = [x.split()[0] for x in SIGNAL.split(", ")]

    def run(rows: pa.Table) -> pa.Table:
        time, flux = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("time", "flux"))
        keep = np.isfinite(time) & np.isfinite(flux)
        order = np.argsort(time[keep], kind="stable")
        time, flux = time[keep][order], flux[keep][order]
        found = windowed(time, flux, np.full(len(time), 1 / flux.var()), durations, window, candidates, grid, pairs) if len(time) >= least and flux.var() > 0 else None
        made = [found] if found else []
        cells = {c: pa.array([None if r[c] != r[c] else r[c] for r in made], pa.int32() if c == "n_events" else pa.float64()) for c in names}
        return pa.table({key: pa.array([rows.column(key)[0].as_py()] * len(made), rows.schema.field(key).type), **cells})

    return series.select(key, "time", "flux").groupBy(key).applyInArrow(run, f"`{key}` {dict(series.dtypes)[key]}, {SIGNAL}")
