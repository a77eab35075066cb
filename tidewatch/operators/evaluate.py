"""Metrics of a ranking: (label 0 or 1, score). One aggregation of distinct scores, then running counts within ranges of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores that running counts are made in.
RANGES = 128
#: Rows of resamples that are summed up at a time.
SLICE = 1 << 13


def _steps(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct scores (of each group of `by`), best first, with counts of positives (p) and of all (n) and running ones (tp, k).

    Scores are cut at quantiles; counts run inside a range, behind the totals of the ranges above it, so that no task
    sees all scores. The quantiles need not be exact: the counts are. Scores that are null or no numbers come last.
    `weight`, if scored has it, says how often a row counts.
    """
    n = F.col("weight") if "weight" in scored.columns else F.lit(1)
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    each = scored.select(*by, score.alias("score"), (F.col("label") * n).alias("p"), n.alias("n")).groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    cuts = scored.agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    # A range's number falls as its scores rise.
    number = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: F.col("score") < c)) if cuts else F.lit(0)
    each = each.withColumn("__r", number)
    totals = each.groupBy(*by, "__r").agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__r", F.coalesce(F.sum("__p").over(before), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__k"))
    w = Window.partitionBy(*by, "__r").orderBy(F.desc("score"))
    out = each.join(totals, [*by, "__r"])
    return out.select(*by, "score", "p", "n", (F.col("__tp") + F.sum("p").over(w)).alias("tp"), (F.col("__k") + F.sum("n").over(w)).alias("k"))


def average_precision(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ap): rows of a tied score are one threshold; null without positives."""
    s = _steps(scored, by)
    ap = F.sum(F.col("p").cast("double") * F.try_divide(F.col("tp"), F.col("k"))) / F.nullif(F.sum("p"), F.lit(0))
    return (s.groupBy(*by) if by else s).agg(ap.alias("ap"))


def roc_auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, auc): the chance that a positive outranks a negative, ties by half; null without both."""
    s = _steps(scored, by)
    # Of the negatives, those not above a score are below it, or share it and count half.
    above = F.col("k") - F.col("tp") - (F.col("n") - F.col("p")) / 2
    sums = (s.groupBy(*by) if by else s).agg(F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"), F.sum(F.col("p").cast("double") * above).alias("a"))
    return sums.select(*by, F.try_divide(F.col("p") * F.col("q") - F.col("a"), F.col("p") * F.col("q")).alias("auc"))


def precision_recall(scored: DataFrame) -> DataFrame:
    """(score, precision, recall) at each distinct score."""
    s = _steps(scored)
    positives = s.agg(F.sum("p").alias("__all"))
    return s.join(F.broadcast(positives), F.lit(True)).select("score", F.try_divide(F.col("tp"), F.col("k")).alias("precision"), F.try_divide(F.col("tp"), F.col("__all")).alias("recall"))


def threshold_for_recall(scored: DataFrame, recall: float) -> DataFrame:
    """(threshold): the highest score at or above which at least that share of the positives lies, one at least; null
    without positives."""
    s = _steps(scored)
    need = s.agg(F.greatest(F.lit(1), F.ceil(F.lit(recall) * F.sum("p"))).alias("__need"))
    return s.join(F.broadcast(need), F.col("tp") >= F.col("__need")).agg(F.max("score").alias("threshold"))


def reweighted_precision(scored: DataFrame, counts: DataFrame, by: str, wanted: Column, threshold: float) -> DataFrame:
    """(passing, precision): how many rows of a catalogue with `counts` (by, n) of each class would reach the threshold, by
    the rates of the scored rows, and the share of those in the wanted classes. Classes without a scored row are left out."""
    rates = scored.groupBy(by).agg(F.avg((F.col("score") >= threshold).cast("double")).alias("__r"))
    passing = rates.join(counts, by).withColumn("__x", F.col("__r") * F.col("n"))
    return passing.agg(F.sum("__x").alias("passing"), F.try_divide(F.coalesce(F.sum(F.when(wanted, F.col("__x"))), F.lit(0.0)), F.sum("__x")).alias("precision"))


#: Cumulative probabilities of the Poisson distribution of mean 1, from 0.
_POISSON = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887]


def _weight(name: Column) -> Column:
    """How often a row of this name is drawn."""
    drawn = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.size(F.filter(F.array(*map(F.lit, _POISSON)), lambda c: drawn >= c))


def resampled(scored: DataFrame, resamples: int, unit: str, seed: int = 0) -> DataFrame:
    """scored a number of times, with resample (from 0) and weight: how often a row counts there, drawn from a Poisson
    distribution of mean 1, as for drawing with replacement from many. Rows of one unit (a row's id, or its star) are drawn
    together, and alike for all scores that are compared. Rows of weight 0 are left out."""
    rows = scored.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    return rows.withColumn("weight", _weight(F.concat_ws(":", F.lit(seed), "resample", unit))).filter("weight > 0")


def resampled_precision(scored: DataFrame, scores: list[str], resamples: int, unit: str, seed: int = 0) -> DataFrame:
    """(ranker, resample, positives, ap): average precision of each score column in each resample of resampled(), without a row a
    row and resample. Null without positives.

    A row carries its weights as an array of bytes. Scores are cut at quantiles; a range is summed up in a task, a bounded number
    of rows at a time, once for its totals and once, behind the totals of the ranges above, for its share of the
    precision. A score that fills ranges by itself is a range of its own, which needs its totals only, and is dealt to many tasks.
    """
    def finite(c: str) -> Column:
        return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))

    found = scored.agg(*[F.percentile_approx(finite(c), [i / RANGES for i in range(1, RANGES)], 1000) for c in scores]).first()

    def placed(c: str, cuts: list[float]) -> Column:
        heavy = sorted({x for x in cuts if cuts.count(x) > 1})
        above = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: finite(c) < x)) if cuts else F.lit(0)
        alone = finite(c).isin(heavy) if heavy else F.lit(False)
        salt = F.when(alone, F.pmod(F.xxhash64(unit), F.lit(RANGES))).otherwise(0)
        return F.struct(F.lit(c).alias("ranker"), finite(c).alias("score"), (2 * above + alone.cast("int")).alias("r"), salt.cast("int").alias("salt"))

    draws = F.transform(F.sequence(F.lit(0), F.lit(resamples - 1)), lambda b: _weight(F.concat_ws(":", F.lit(seed), b.cast("string"), F.col(unit).cast("string"))).cast("byte"))
    each = F.explode(F.array(*[placed(c, found[i] or []) for i, c in enumerate(scores)])).alias("x")
    long = scored.select(F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("label"), draws.alias("w"), each).select("x.*", "label", "w")
    key = ["ranker", "r"]
    lists = pa.list_(pa.float64())

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def row(table: pa.Table, **values: np.ndarray) -> pa.Table:
        return pa.table({c: table.column(c).slice(0, 1) for c in key} | {c: pa.array([v], lists) for c, v in values.items()})

    def totals(table: pa.Table) -> pa.Table:
        p, n = np.zeros(resamples), np.zeros(resamples)
        for at in range(0, table.num_rows, SLICE):
            part = table.slice(at, SLICE)
            w = matrix(part.column("w")).astype(float)
            p, n = p + part.column("label").to_numpy() @ w, n + w.sum(axis=0)
        return row(table, p=p, n=n)

    def offsets(table: pa.Table) -> pa.Table:
        """The totals of the ranges above each, and what ranges of one score give."""
        r = table.column("r").to_numpy()
        own, at = np.unique(r, return_inverse=True)
        p, n = np.zeros((len(own), resamples)), np.zeros((len(own), resamples))
        np.add.at(p, at, matrix(table.column("p")))
        np.add.at(n, at, matrix(table.column("n")))
        tp, k = p.cumsum(axis=0), n.cumsum(axis=0)
        gives = np.where((own % 2 == 1)[:, None], p * tp / np.maximum(k, 1), 0.0)
        rows = {"p": p, "tp": tp - p, "k": k - n, "gives": gives}
        return pa.table({"ranker": pa.array([table.column("ranker")[0].as_py()] * len(own)), "r": pa.array(own, pa.int32())} | {c: pa.array(list(v), lists) for c, v in rows.items()})

    def shares(rows: pa.Table, before: pa.Table) -> pa.Table:
        tp, k, gives = (matrix(before.column(c))[0] for c in ("tp", "k", "gives"))
        order = np.argsort(-rows.column("score").to_numpy(), kind="stable") if rows.num_rows else np.zeros(0, int)
        at = 0
        while at < len(order):
            part = rows.take(order[at : at + SLICE])
            score = part.column("score").to_numpy()
            # A slice ends where a score does, but for a score longer than a slice.
            if at + SLICE < len(order) and score[0] != score[-1]:
                part = part.slice(0, int(np.searchsorted(-score, -score[-1])))
            elif score[0] == score[-1]:
                part = rows.take(order[at : at + int((rows.column("score").to_numpy()[order[at:]] == score[0]).sum())])
            at += part.num_rows
            score, label, w = part.column("score").to_numpy(), part.column("label").to_numpy(), matrix(part.column("w")).astype(float)
            starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
            p, n = np.add.reduceat(w * label[:, None], starts), np.add.reduceat(w, starts)
            tps, ks = tp + p.cumsum(axis=0), k + n.cumsum(axis=0)
            gives = gives + (p * tps / np.maximum(ks, 1)).sum(axis=0)
            tp, k = tps[-1], ks[-1]
        return row(before, p=matrix(before.column("p"))[0], gives=gives)

    arrays = "p array<double>, {} array<double>"
    sums = long.groupBy(*key, "salt").applyInArrow(totals, "ranker string, r int, " + arrays.format("n"))
    before = sums.groupBy("ranker").applyInArrow(offsets, "ranker string, r int, " + arrays.format("tp") + ", k array<double>, gives array<double>")
    gives = long.filter("r % 2 = 0").groupBy(*key).cogroup(before.groupBy(*key)).applyInArrow(shares, "ranker string, r int, " + arrays.format("gives"))
    every = gives.select("ranker", F.posexplode(F.arrays_zip("p", "gives")).alias("resample", "x"))
    out = every.groupBy("ranker", "resample").agg(F.sum("x.p").alias("positives"), F.sum("x.gives").alias("g"))
    return out.select("ranker", "resample", "positives", F.try_divide("g", "positives").alias("ap"))


def bootstrap_interval(scored: DataFrame, resamples: int, unit: str, share: float = 0.68, seed: int = 0) -> DataFrame:
    """(low, high, n): the middle `share` of average precision over resamples with two positives or more, and how many."""
    ap = resampled_precision(scored, ["score"], resamples, unit, seed).filter("positives >= 2")
    return ap.agg(F.percentile("ap", (1 - share) / 2).alias("low"), F.percentile("ap", (1 + share) / 2).alias("high"), F.count("*").alias("n"))


def win_rate(scored: DataFrame, other: str, resamples: int, unit: str, seed: int = 0) -> DataFrame:
    """(win_rate, low, high, n): in how many resamples score has a higher average precision than the column `other`, and the
    middle 95 % of the difference."""
    each = resampled_precision(scored, ["score", other], resamples, unit, seed).groupBy("resample")
    d = each.agg((F.max(F.when(F.col("ranker") == "score", F.col("ap"))) - F.max(F.when(F.col("ranker") == other, F.col("ap")))).alias("d")).filter("d IS NOT NULL")
    return d.agg(F.avg((F.col("d") > 0).cast("double")).alias("win_rate"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.count("*").alias("n"))


def recall_by(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, low, high, n, recall, recovery, recall_of_recovered) of the positives whose value is in each bin [low, high): the share that is predicted,
    the share that the search recovered, and the share predicted of those. Empty bins stay, with null shares.
    rows: label, predicted, recovered, value."""
    number = F.lit(-1)
    for e in edges:
        number = number + F.when(F.col(value) >= e, 1).otherwise(0)
    hit, seen = (F.col("predicted") == 1).cast("double"), F.col("recovered") == 1
    got = rows.filter("label = 1").groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(hit).alias("recall"), F.avg(seen.cast("double")).alias("recovery"), F.avg(F.when(seen, hit)).alias("recall_of_recovered"))
    every = rows.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"), F.get(F.array(*map(F.lit, edges)), F.col("id").cast("int")).alias("low"), F.get(F.array(*map(F.lit, edges)), F.col("id").cast("int") + 1).alias("high"))
    return every.join(F.broadcast(got), "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "recall", "recovery", "recall_of_recovered")


def precision_at(scored: DataFrame, ks: list[int], tie: str) -> DataFrame:
    """(k, precision) of the first k by score, ties by a column."""
    top = scored.orderBy(F.desc("score"), tie).limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), tie)))
    return top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("r <= k").groupBy("k").agg(F.avg(F.col("label").cast("double")).alias("precision"))


def wilson(p: Column, n: Column, z: float) -> Column:
    """Lower end of Wilson's interval for p successes of n."""
    r = p / n
    return (r + z * z / (2 * n) - z * F.sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def wilson_threshold(scored: DataFrame, precision: float, z: float = 1.0, least: int = 5) -> DataFrame:
    """(threshold, k): the deepest cut whose Wilson bound reaches the precision; else by the plain precision; else the
    best of at least `least` rows."""
    s = _steps(scored)
    bound, plain = wilson(F.col("tp").cast("double"), F.col("k").cast("double"), z), F.col("tp") / F.col("k")
    kind = F.when(bound >= precision, 0).when(plain >= precision, 1).when(F.col("k") >= least, 2)
    order = F.struct(kind.alias("kind"), F.when(kind == 2, -F.round(plain, 9)).otherwise(-F.col("k").cast("double")).alias("m"), "k", "score")
    return s.filter(kind.isNotNull()).agg(F.min(order).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.k").alias("k"), F.col("b.kind").alias("kind"))


def reliability(scored: DataFrame, bins: int) -> DataFrame:
    """(bin, n, positives, mean_p, rate): equal bins of probability, the last closed; empty bins stay."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    got = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg("score").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("rate"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"), "mean_p", "rate")


def calibration(scored: DataFrame, bins: int) -> DataFrame:
    """(n, brier, log_loss, ece)."""
    p, y = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score"))), F.col("label").cast("double")
    one = scored.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("score") - y, F.lit(2.0))).alias("brier"), (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))
    ece = reliability(scored, bins).filter("n > 0").agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return one.join(F.broadcast(ece))


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1) at a threshold."""
    hit, y = F.col("score") >= threshold, F.col("label") == 1

    def n(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    c = scored.agg(n(hit & y).alias("tp"), n(hit & ~y).alias("fp"), n(~hit & y).alias("fn"), n(~hit & ~y).alias("tn"))
    return c.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"), (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


def prior_shift(p: Column, trained: float, wanted: float) -> Column:
    """A probability at another share of positives: the log-odds move by the difference of the shares' log-odds."""
    shift = F.ln(F.lit(wanted / (1 - wanted))) - F.ln(F.lit(trained / (1 - trained)))
    return 1 / (1 + F.exp(-(F.ln(p / (1 - p)) + shift)))


def compare_rankers(rows: DataFrame, scores: list[str], by: str, threshold: dict[str, float] | None = None) -> DataFrame:
    """(by, ranker, n, positives, chance, ap, auc, passing, pass_precision): every score column on the same rows, for each value of
    `by` and (null) over all; rows with no label or a null `by` are left out. passing: rows at the ranker's threshold or above.

    All rankers and groups go through one aggregation of distinct scores: rankers and the two groups of a row are put below
    each other first, at the width of a label and a score.
    """
    known = rows.filter(F.col("label").isNotNull() & F.col(by).isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("ranker"), F.col(c).cast("double").alias("score"), F.lit((threshold or {}).get(c)).cast("double").alias("cut")) for c in scores])).alias("x")
    long = known.select(F.col(by).cast("string").alias("g"), "label", pairs).select("g", "label", "x.*").withColumn("g", F.explode(F.array("g", F.lit(None).cast("string"))))
    long = long.withColumn("g", F.coalesce(F.concat(F.lit("="), "g"), F.lit("")))  # a key that is never null
    s = _steps(long, ("g", "ranker"))
    above = F.col("k") - F.col("tp") - (F.col("n") - F.col("p")) / 2
    cuts = F.create_map(*[x for c in scores for x in (F.lit(c), F.lit((threshold or {}).get(c)).cast("double"))])
    passes = F.col("score") >= F.try_element_at(cuts, F.col("ranker"))
    out = s.groupBy("g", "ranker").agg(
        F.sum("n").alias("n"), F.sum("p").alias("positives"), F.sum(F.col("p").cast("double") * F.try_divide(F.col("tp"), F.col("k"))).alias("a"), F.sum(F.col("p").cast("double") * above).alias("u"),
        F.coalesce(F.sum(F.when(passes, F.col("n"))), F.lit(0)).alias("passing"), F.sum(F.when(passes, F.col("p"))).alias("hits"),
    )
    p, q = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return out.select(
        F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias(by), "ranker", "n", "positives", (p / F.col("n")).alias("chance"), F.try_divide(F.col("a"), p).alias("ap"),
        F.try_divide(p * q - F.col("u"), p * q).alias("auc"), "passing", F.try_divide(F.col("hits"), F.col("passing")).alias("pass_precision"),
    )


def _forecasts(rows: DataFrame, forecasts: dict[str, Column], unit: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("forecast"), v.cast("double").alias("p")) for k, v in forecasts.items()])).alias("x")
    return rows.filter("label IS NOT NULL").select(F.col(unit).alias("unit"), F.col("label").cast("double").alias("y"), each).select("unit", "y", "x.*").filter("p IS NOT NULL AND NOT isnan(p)")


def forecast_scores(rows: DataFrame, forecasts: dict[str, Column], bins: int, unit: str) -> DataFrame:
    """(forecast, n, brier, log_loss, ece, expected, observed): proper scores of several probabilities on the same labels, the
    calibration error over equal bins, and the positives that each promises. One grouping by forecast and bin."""
    long = _forecasts(rows, forecasts, unit)
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    loss = -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))
    parts = long.groupBy("forecast", b.alias("b")).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("s"), F.sum(loss).alias("l"), F.sum("p").alias("e"), F.sum("y").alias("o"))
    n = F.sum("n")
    return parts.groupBy("forecast").agg(n.alias("n"), (F.sum("s") / n).alias("brier"), (F.sum("l") / n).alias("log_loss"), (F.sum(F.abs(F.col("e") - F.col("o"))) / n).alias("ece"), F.sum("e").alias("expected"), F.sum("o").cast("long").alias("observed"))


def brier_intervals(rows: DataFrame, forecasts: dict[str, Column], unit: str, resamples: int, share: float = 0.68, seed: int = 0) -> DataFrame:
    """(forecast, low, high): the middle `share` of the Brier score when units (stars) are resampled. Rows are summed up by unit
    first; only sums of units are drawn, alike for all forecasts."""
    sums = _forecasts(rows, forecasts, unit).groupBy("forecast", "unit").agg(F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("s"), F.count("*").alias("n"))
    drawn = resampled(sums, resamples, "unit", seed).groupBy("forecast", "resample").agg((F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("b"))
    return drawn.groupBy("forecast").agg(F.percentile("b", (1 - share) / 2).alias("low"), F.percentile("b", (1 + share) / 2).alias("high"))


def probability_threshold(rows: DataFrame, slope: float, intercept: float, probability: float) -> DataFrame:
    """(threshold, kept, precision, recall): where a logistic curve over raw (out-of-fold log-odds) reaches a probability: the score
    1 / (1 + exp(-cut)) there, the rows at it or above, and their precision and recall."""
    if not 0 < probability < 1:
        raise ValueError(f"a probability must lie between 0 and 1, not {probability}")
    cut = (math.log(probability / (1 - probability)) - intercept) / slope
    kept = (F.col("raw") >= cut) & ~F.isnan("raw")
    hits = F.sum(F.when(kept, F.col("label")))
    out = rows.filter("label IS NOT NULL").agg(F.count(F.when(kept, 1)).alias("kept"), hits.alias("h"), F.sum("label").alias("p"))
    return out.select(F.lit(1 / (1 + math.exp(-cut))).alias("threshold"), "kept", F.try_divide(F.col("h"), F.col("kept")).alias("precision"), F.try_divide(F.coalesce("h", F.lit(0)), F.col("p")).alias("recall"))
