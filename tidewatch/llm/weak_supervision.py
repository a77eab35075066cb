"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns (at most
3 to the number of rules, whatever the corpus) estimates how each rule votes on good and on bad documents, and the
posterior probability that a document is good decides instead of an all-must-pass filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import SPACE, quoted, table, text_or_empty, written

BAD, NONE, GOOD = 0, 1, 2


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more counts.

    All of it stays inside the row: no exchange. Three-word windows are compared by 64-bit hashes; only texts with an
    equal pair of windows sort them. Null texts count as empty and have zeros everywhere. A very long text costs what it is
    long; repeated rows are counted each; an empty table gives no rows; columns of other names play no part.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    rows = rows.select(
        "doc_id", F.array_remove(F.split("t", SPACE), "").alias("w"),
        (F.size(F.split("t", r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split("t", r"[#*$%&|<>]+", -1)) - 1).cast("long").alias("n_symbol_runs"),
        (F.size(F.split("t", "[A-Z]", -1)) - 1).cast("long").alias("n_upper"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
    )
    windows = F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))")
    rows = rows.select(
        "doc_id", "n_symbols", "n_symbol_runs", "n_upper", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.when(F.size("w") >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr("array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))"))).drop("h")
    repeated = "filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false))"
    rows = rows.withColumn("p", F.expr(f"array_sort(transform({repeated}, x -> x.i))")).drop("s")
    covered = "aggregate(p, named_struct('last', -3, 'n', 0), (a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)"
    return rows.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("p")


def _votes() -> dict[str, Column]:
    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)

    n = F.greatest(F.col("n_words"), F.lit(1))
    mean, symbols, repeats = F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_repeat_words") / n
    lines, upper, distinct = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_distinct") / n
    return {
        "length": vote(F.col("n_words") < 50, F.col("n_words") >= 200),
        "word_length": vote((mean < 3) | (mean > 10), (mean >= 3.5) & (mean <= 8)),
        "symbols": vote(symbols > 0.1, symbols <= 0.01),
        "symbol_density": vote(F.col("n_symbols") > 0.03 * F.col("word_chars"), F.col("n_symbols") == 0),
        "symbol_runs": vote(F.col("n_symbol_runs") > 0.1 * n, F.col("n_symbol_runs") <= 0.01 * n),
        "dup_lines": vote(lines > 0.3, lines <= 0.05),
        "repeats": vote(repeats > 0.2, repeats <= 0.05),
        "upper": vote(upper > 0.3, upper <= 0.1),
        "distinct": vote((distinct < 0.1) & (n >= 20), distinct >= 0.3),
    }


def label_model(votes: DataFrame, rules: list[str], rounds: int = 12, prior: float = 0.7) -> Column:
    """The posterior probability of good, as an expression over the rules' columns of votes (0 bad, 1 none, 2 good).

    votes is reduced to counts of vote patterns first. A round is one aggregation of those counts to one row: six sums a
    rule. Rules are taken as independent given the class; sums are smoothed by one pattern of each kind. The start
    says what the rules are written for: to call a good document bad is rare, to call a bad one good is not, as a kind of
    junk trips its own rule and passes the others. Without rows the start stands.
    """
    patterns = written(votes.groupBy(*rules).agg(F.count("*").alias("n")), "vote-patterns")
    chance = {r: {0: [0.35, 0.20, 0.45], 1: [0.01, 0.34, 0.65]} for r in rules}

    def posterior() -> Column:
        logit = F.lit(math.log(prior / (1 - prior)))
        for r in rules:
            logit += F.element_at(F.array(*[F.lit(math.log(chance[r][1][v] / chance[r][0][v])) for v in (BAD, NONE, GOOD)]), F.col(r).cast("int") + 1)
        return 1 / (1 + F.exp(-logit))

    for _ in range(rounds):
        p = patterns.withColumn("p", posterior())
        sums = [F.sum(F.when(F.col(r) == v, F.col("n") * q).otherwise(0.0)).alias(f"{r}_{c}_{v}") for r in rules for c, q in ((1, F.col("p")), (0, 1 - F.col("p"))) for v in (BAD, NONE, GOOD)]
        row = p.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("good"), *sums).first()
        if not row["n"]:
            break
        was, prior = prior, min(0.99, max(0.01, row["good"] / row["n"]))
        for r in rules:
            for c in (0, 1):
                found = [row[f"{r}_{c}_{v}"] + 1.0 for v in (BAD, NONE, GOOD)]
                chance[r][c] = [x / sum(found) for x in found]
        if abs(prior - was) < 1e-4:
            break
    return posterior()


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """statistics() with a column of votes a rule, quality_probability, base_failed and kept.

    One row a row of docs, null and empty texts included (they fail the base: fewer than 50 words).
    """
    rules = _votes()
    voted = written(statistics(docs, doc_id, text).withColumns(rules), "votes")
    scored = voted.withColumn("quality_probability", label_model(voted, list(rules)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))


def op2_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")
