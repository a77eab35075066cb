"""Mixing sources to target weights by pivotal dependent rounding.

Each document is owed a fractional number of copies. The whole part is given. The fractions of a source are rounded so
that its expected words stay what they are: documents of like size duel in cells of bounded size, each duel moves words
from one to the other until one is integral, and the document that a cell leaves fractional goes up a reduction tree. At
its root a source has a document a size class left. Those duel from the longest down, each with all the shorter ones
together, which take over what rounding it leaves; so what is left in the end is about one short document.

Only hashes and sizes go through the tree; whole rows are met again at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import columns_of, numbered, quoted, ranked, table, without, words, written

#: Documents in a cell.
CELL_ROWS = 256
_EPS = 1e-9
_ID = ["__h", "__g", "__j"]


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """sizes (source, source_size; one row a source) with target.

    Sources in code point order, null last, weigh 1, 2, 3 and again. Their targets share the sum of all sizes by
    weight; one above cap times its source's size stops there and the rest is shared again until none is above. No
    source or no words: targets of 0. Ranks are given range by range, and a round of sharing is one sum over the sources.
    """
    rows = ranked(sizes, F.col("source").asc_nulls_last()).withColumn("__w", F.pmod(F.col("__rank"), F.lit(3)) + 1)
    rows = written(rows.select("source", "source_size", "__w"), "weights")
    limit, level, n = F.col("source_size") * cap, 0.0, -1
    while True:
        stopped = F.col("__w") * level > limit
        s = rows.agg(F.sum("source_size"), F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("__w"))), F.count(F.when(stopped, 1))).first()
        if s[3] == n or not s[2]:
            break
        n, level = s[3], (s[0] - (s[1] or 0.0)) / s[2]
    return rows.select("source", "source_size", F.least(F.col("__w") * level, limit).cast("double").alias("target"))


def _draw(row: str, *salt: int) -> str:
    return f"(pmod(xxhash64({row}.__h, {row}.__g, {row}.__j, {', '.join(map(str, salt))}), 9007199254740992L) / 9007199254740992D)"


def _members() -> Column:
    return F.array_sort(F.collect_list(F.struct((-F.col("__words")).alias("__less"), *_ID, "__words", "__p")))


def _duels(rows: DataFrame, by: list[str], level: int, seed: int) -> DataFrame:
    """Documents of each group duel, the longest first. rows: by, ids, __words, __p. All come back: __extra is 0 or 1, or
    null with a new __p for the one that a group leaves fractional.

    A duel moves expected words, not copies, from one document to the other until one is integral, with the chances
    that keep both expectations; so a group's expected words stay exactly as they were.
    """
    gain, loss = "least(a.w * (1D - a.p), x.__words * x.__p)", "least(a.w * a.p, x.__words * (1D - x.__p))"

    def end(out: str, extra: int, held: str, p: str) -> str:
        i, w = ("a.i", "a.w") if held == "a" else ("a.n", "cast(x.__words AS double)")
        return f"named_struct('i', {i}, 'w', {w}, 'p', {p}, 'n', a.n + 1, 'out', array_append(a.out, named_struct('i', {'a.i' if out == 'a' else 'a.n'}, 'extra', {extra})))"

    step = f"""
      CASE WHEN {_draw("x", seed, level)} * ({gain} + {loss}) < {loss} THEN
        CASE WHEN x.__words * x.__p <= a.w * (1D - a.p) THEN {end("x", 0, "a", f"a.p + {gain} / a.w")} ELSE {end("a", 1, "x", f"x.__p - {gain} / x.__words")} END
      ELSE
        CASE WHEN a.w * a.p <= x.__words * (1D - x.__p) THEN {end("a", 0, "x", f"x.__p + {loss} / x.__words")} ELSE {end("x", 1, "a", f"a.p - {loss} / a.w")} END
      END"""
    start = "named_struct('i', 0, 'w', cast(__rows[0].__words AS double), 'p', __rows[0].__p, 'n', 1, 'out', cast(array() AS array<struct<i: int, extra: int>>))"
    fought = rows.groupBy(*by).agg(_members().alias("__rows")).withColumn("__end", F.expr(f"aggregate(slice(__rows, 2, size(__rows)), {start}, (a, x) -> {step})"))
    ends = F.expr("concat(transform(__end.out, o -> named_struct('i', o.i, 'extra', o.extra, 'p', cast(null AS double))), array(named_struct('i', __end.i, 'extra', cast(null AS int), 'p', __end.p)))")
    out = fought.select(*by, "__rows", F.explode(ends).alias("__o"))
    return out.select(*by, F.col("__o.p").alias("__p"), F.col("__o.extra").alias("__extra"), *[F.expr(f"__rows[__o.i].{c}").alias(c) for c in (*_ID, "__words")])


def _settled(rows: DataFrame, by: list[str], level: int, seed: int) -> DataFrame:
    """ids and __extra (0 or 1) of all rows (as in _duels). From the longest down, a document duels with all shorter ones
    of its group together, whose chances move by the same share of what each has or lacks. It is integral after that, or
    they all are and it is drawn by its own chance."""
    let = "transform(array({}), {} -> {})[0]".format
    moved = let(
        "named_struct('gains', " + _draw("x", seed, level) + " * (v.up + v.down) < v.down, 'up', v.up, 'down', v.down, 'p', v.p, 'mass', v.mass, 'room', v.room)", "m",
        f"""named_struct('alpha', CASE WHEN m.gains THEN a.alpha * (1D - coalesce(try_divide(m.up, m.mass), 0D)) ELSE a.alpha * (1D - coalesce(try_divide(m.down, m.room), 0D)) END,
          'beta', CASE WHEN m.gains THEN a.beta * (1D - coalesce(try_divide(m.up, m.mass), 0D)) ELSE 1D - (1D - a.beta) * (1D - coalesce(try_divide(m.down, m.room), 0D)) END,
          'mass', CASE WHEN m.gains THEN m.mass - m.up ELSE m.mass + m.down END, 'words', a.words - x.__words,
          'out', array_append(a.out, CASE WHEN {_draw("x", seed, level, 1)} < CASE WHEN m.gains THEN round(m.p + m.up / x.__words, 9) ELSE round(m.p - m.down / x.__words, 9) END THEN 1 ELSE 0 END))""",
    )
    step = let(
        "least(1D, greatest(0D, a.alpha * x.__p + a.beta))", "p",
        let(
            "named_struct('p', p, 'mass', greatest(0D, a.mass - x.__words * p), 'room', greatest(0D, a.words - x.__words - greatest(0D, a.mass - x.__words * p)))", "r",
            let("named_struct('p', r.p, 'mass', r.mass, 'room', r.room, 'up', least(x.__words * (1D - r.p), r.mass), 'down', least(x.__words * r.p, r.room))", "v", moved),
        ),
    )
    start = "named_struct('alpha', 1D, 'beta', 0D, 'mass', __mass, 'words', __all, 'out', cast(array() AS array<int>))"
    fought = rows.groupBy(*by).agg(_members().alias("__rows"), F.sum(F.col("__words") * F.col("__p")).alias("__mass"), F.sum("__words").cast("double").alias("__all"))
    fought = fought.withColumn("__extra", F.expr(f"aggregate(__rows, {start}, (a, x) -> {step}, a -> a.out)"))
    out = fought.select(F.explode(F.arrays_zip("__rows", "__extra")).alias("__o"))
    return out.select(*[F.col(f"__o.__rows.{c}").alias(c) for c in _ID], F.col("__o.__extra").alias("__extra"))


def mix(docs: DataFrame, size: Column, source: str = "source", cap: float = 3.0, seed: int = 29) -> DataFrame:
    """docs with size, source_size, target and copies (at most cap, whole numbers).

    size counts a row's words (null: 0); a row without any is owed its source's whole copies and no chance of more. Null
    sources are one source. Rows equal in all columns are rows of their own. Reruns agree, whatever the layout: every draw
    hashes the row, its level and the seed. Texts of any length cost the tree the same, as only their size goes through it.
    Empty tables give no rows. Input columns named as the new ones are replaced; others, whatever their names and types,
    come back. Ties of size are settled by hashes.
    """
    columns = without(docs, "size", "source_size", "target", "copies")
    words_of = F.coalesce(size.cast("long"), F.lit(0)).alias("__size")
    rows = numbered(docs.select(F.struct(*columns_of(columns)).alias("__row"), quoted(source).alias("__s"), words_of))
    # What goes through the tree: some 40 bytes a document.
    sizes = rows.select(*_ID, "__s", F.col("__size").alias("__words"))
    sizes = written(sizes.withColumn("__class", F.when(F.col("__words") > 0, F.floor(F.log2("__words") * 8).cast("int")).otherwise(-1)), "mix-sizes")
    classes = written(sizes.groupBy("__s", "__class").agg(F.count("*").alias("__n"), F.sum("__words").alias("__words")), "mix-classes")
    goals = targets(classes.groupBy(F.col("__s").alias("source")).agg(F.sum("__words").alias("source_size")), cap)
    owed = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = classes.join(goals, F.col("__s").eqNullSafe(F.col("source"))).select(
        F.col("__s").alias("__ps"), F.col("__class").alias("__pclass"), "source_size", "target", owed.alias("__owed"),
        F.ceil(F.col("__n") / CELL_ROWS).cast("long").alias("__cells"),
    )
    plan = written(plan, "mix-plan")
    most_cells = plan.agg(F.max("__cells")).first()[0] or 1
    whole = F.floor(F.col("__owed") + _EPS)
    rest = F.greatest(F.lit(0.0), F.col("__owed") - whole)
    owing = sizes.join(plan, F.col("__s").eqNullSafe(F.col("__ps")) & (F.col("__class") == F.col("__pclass"))).select(
        *_ID, "__s", "__class", "__words", F.pmod(F.xxhash64(*_ID, F.lit(seed + 1)), F.col("__cells")).alias("__cell"),
        F.when((F.col("__class") < 0) | (rest < _EPS), 0.0).otherwise(rest).alias("__p"), "source_size", "target", whole.cast("int").alias("__whole"),
    )
    groups, level, done = ["__s", "__class", "__cell"], 0, []
    left = owing.filter("__p > 0").select(*groups, *_ID, "__words", "__p")
    while True:
        fought = written(_duels(left, groups, level, seed), f"mix-{level}")
        done.append(fought.filter("__extra IS NOT NULL").select(*_ID, "__extra"))
        left, level = fought.filter("__extra IS NULL").drop("__extra"), level + 1
        if most_cells <= 1:
            break
        # As many cells of a class meet as documents met in a cell.
        left, most_cells = left.withColumn("__cell", F.floor(F.col("__cell") / CELL_ROWS)), -(-most_cells // CELL_ROWS)
    # A document a class is left to each source: 8 classes for each doubling of the size, so about 200.
    done.append(_settled(left, ["__s"], level, seed))
    extras = done[0]
    for part in done[1:]:
        extras = extras.unionByName(part)
    given = owing.select(*_ID, F.col("__words").alias("size"), "source_size", "target", "__whole").join(extras, _ID, "left")
    given = given.select(*_ID, "size", "source_size", "target", (F.col("__whole") + F.coalesce("__extra", F.lit(0))).cast("int").alias("copies"))
    met = rows.select("__row", *_ID).join(given, _ID)
    return met.select(*[F.col("__row").getField(c).alias(c) for c in columns], "size", "source_size", "target", "copies")


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("n_words")), "sized")
    out = mix(sized, F.col("n_words"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
