"""Personal data: pattern spans, and terms that give protected entities away.

Patterns find e-mail and IP addresses, card and phone numbers. What else stands in a text that holds one is then weighed by
what the corpus says: with N distinct texts, df(e) of them holding entity e, log2(N / df(e)) bits identify e; a term t found with
e in c(e, t) texts, and in df(t) texts at all, leaves -log2(P(e | t)) of them. P(e | t) is smoothed by A prior texts that
hold t, and hold e as often as any text does: (c(e, t) + A df(e) / N) / (df(t) + A), so what one text says counts, but less. Terms
that leave few bits, and tell some, are generalised wherever they stand in a text that holds e or, where they leave fewer
still, removed from every text. What is left is a count of texts among those that hold the term: it does not drift with N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import SMALL, columns_of, table, text_or_empty, without, written

KINDS = ["email", "ip", "card", "phone"]
# The patterns asked for, so written that a search never goes over a run of characters twice: \G is where the last match
# ended, and a look behind keeps a match from starting inside a run whose beginning has failed already.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Words, names and identifiers: runs of letters and digits.
TERM = r"[\p{L}\p{M}\p{N}]+"
#: What a generalised term becomes: the first of these that its text matches.
SHAPES = [("NUMBER", r"^\p{N}+$"), ("ID", r"\p{N}"), ("NAME", r"^\p{Lu}"), ("WORD", r"")]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, valid: str) -> str:
    """SQL for the matches of a pattern in a text that are valid (SQL over x.value): array of (start, end, value), in code
    points, end exclusive.

    Matches are taken by 256: each block is gone through from where the blocks before it end, so that the work grows with
    the matches and not with their square.
    """
    p, empty = _quoted(pattern), "cast(array() AS array<struct<start: int, end: int, value: string>>)"
    pairs = f"filter(zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, g) -> named_struct('value', m, 'g', g)), x -> x.value IS NOT NULL)"
    blocks = "CASE WHEN size(p) = 0 THEN cast(array() AS array<array<struct<value: string, g: string>>>) ELSE transform(sequence(0, (size(p) - 1) div 256), i -> slice(p, cast(i * 256 + 1 AS int), 256)) END"
    starts = "aggregate(c, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, s) -> named_struct('at', a.at + aggregate(s, 0, (n, x) -> n + length(x.g) + length(x.value)), 'out', array_append(a.out, a.at)), a -> a.out)"
    inside = f"""aggregate(s, named_struct('at', o, 'out', {empty}), (a, x) -> named_struct('at', a.at + length(x.g) + length(x.value), 'out', CASE WHEN {valid} THEN
      array_append(a.out, named_struct('start', a.at + length(x.g), 'end', a.at + length(x.g) + length(x.value), 'value', x.value)) ELSE a.out END), a -> a.out)"""
    # An array of one gives a value a name, so that it is made once.
    return f"transform(array({pairs}), p -> transform(array({blocks}), c -> flatten(zip_with(c, {starts}, (s, o) -> {inside})))[0])[0]"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _valid(kind: str) -> str:
    if kind == "ip":  # four numbers of at most 255, leading zeros allowed
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"
        return f"x.value RLIKE {_quoted('^' + part + ('[.]' + part) * 3 + '$')}"
    if kind == "phone":
        return f"length({_digits('x.value')}) BETWEEN 10 AND 15"
    if kind == "card":
        d = _digits("x.value")
        luhn = f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring(reverse({d}), i, 1) AS int) ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring(reverse({d}), i, 1) AS int) + 1) END) % 10 = 0"
        return f"CASE WHEN length({d}) BETWEEN 14 AND 19 THEN {luhn} ELSE false END"
    return "true"


def base_spans(text: str = "t") -> str:
    """SQL for the pattern spans of a text: array of (start, k, end, kind, value), by start, then kind."""
    found = []
    for k, kind in enumerate(KINDS):
        spans = f"transform({_spans(text, PATTERNS[kind], _valid(kind))}, x -> named_struct('start', x.start, 'k', {k}, 'end', x.end, 'kind', '{kind}', 'value', x.value))"
        gate = f"contains({text}, '@')" if kind == "email" else f"{text} RLIKE {_quoted(GATES[kind])}"
        found.append(f"CASE WHEN {gate} THEN {spans} ELSE cast(array() AS array<struct<start: int, k: int, end: int, kind: string, value: string>>) END")
    return f"array_sort(concat({', '.join(found)}))"


def _outside(text: str = "t", spans: str = "s") -> str:
    """SQL for the text with its spans blanked, so that what is left stands where it stood."""
    return f"""aggregate({spans}, named_struct('at', 0, 'out', cast(array() AS array<string>)),
      (a, x) -> named_struct('at', greatest(a.at, x.end), 'out', array_append(a.out, concat(substring({text}, a.at + 1, greatest(x.start - a.at, 0)), repeat(' ', x.end - greatest(a.at, x.start))))),
      a -> concat(array_join(a.out, ''), substring({text}, a.at + 1, length({text}) - a.at)))"""


def _term_spans(text: str, kinds: str) -> str:
    """SQL for where the terms that are keys of `kinds` (a map to their kind) stand in a text, as spans."""
    p = _quoted(TERM)
    pairs = f"filter(zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, g) -> named_struct('m', m, 'g', g)), x -> x.m IS NOT NULL)"
    return f"""aggregate({pairs},
      named_struct('at', 0, 'out', cast(array() AS array<struct<start: int, k: int, end: int, kind: string, value: string>>)),
      (a, x) -> named_struct('at', a.at + length(x.g) + length(x.m), 'out', CASE WHEN map_contains_key({kinds}, lower(x.m)) THEN array_append(a.out,
        named_struct('start', a.at + length(x.g), 'k', {len(KINDS)}, 'end', a.at + length(x.g) + length(x.m), 'kind', element_at({kinds}, lower(x.m)), 'value', lower(x.m))) ELSE a.out END),
      a -> a.out)"""


def _distinct_terms(text: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.lower))


def document_frequency(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many different texts of docs each term of wanted (term, distinct) occurs, over all rows and whole
    texts (not null). A row of docs that has `times` copies counts 1 / times, so that texts need not be brought together.

    Each task counts its terms first, so that a common one is a row a task.
    """
    each = docs.select("times", F.explode(_distinct_terms(text)).alias("term"))
    return each.groupBy("term").agg(F.round(F.sum(1 / F.col("times"))).cast("long").alias("df")).join(wanted, "term", "left_semi")


def sanitise(docs: DataFrame, text: str = "text", generalise: float = 4.0, remove: float = 1.5, told: float = 2.0, prior: float = 4.0) -> DataFrame:
    """docs with pii_spans (array of start, k, end, kind, value; patterns and terms) and sanitised (the text without them).

    Pattern spans become [EMAIL] and so on; terms, wherever they stand in the text, are removed (kind term_removed) or generalised
    to what they look like (term_general): [NUMBER], [ID] (letters and digits), [NAME] (a capital first) or [WORD]. Spans that overlap are replaced once, by the first. `prior` texts are added to those that hold a term, so that pairs of
    entity and term seen in one text are weighed too. A term is generalised if it leaves at most `generalise` bits of an entity
    (one of 16 texts with it), removed at `remove`, and in either case tells `told` bits at least. Null and empty texts have no spans and come out empty; equal texts
    count once and get the same spans. An empty table gives no rows. A very long text is one row: its terms are counted once
    each. Input columns named as the new ones are replaced; others, whatever their names and types, come back.
    """
    columns = without(docs, "pii_spans", "sanitised")
    base = docs.select(F.struct(*columns_of(columns)).alias("__row"), text_or_empty(text).alias("t"))
    base = base.withColumns({"__a": F.xxhash64("t"), "__b": F.xxhash64(F.reverse("t"), F.lit(1)), "s": F.expr(base_spans())})
    # What holds a pattern span is few and small; it is kept, as several readers follow.
    marked = written(base.filter(F.size("s") > 0), "pii-marked")
    # Equal texts count once.
    hashes = docs.select(text_or_empty(text).alias("t")).select("t", F.xxhash64("t").alias("__a"), F.xxhash64(F.reverse("t"), F.lit(1)).alias("__b"))
    copies = written(hashes.groupBy("__a", "__b").agg(F.count("*").alias("times")), "pii-copies")
    n, again = copies.count(), copies.filter("times > 1")
    again = F.broadcast(again) if again.limit(SMALL + 1).count() <= SMALL else again
    texts = hashes.join(again, ["__a", "__b"], "left").withColumn("times", F.coalesce("times", F.lit(1)))
    once = marked.groupBy("__a", "__b").agg(F.first("s").alias("s"), F.first("t").alias("t")).withColumn("t", F.expr(_outside()))
    once = once.select("__a", "__b", F.array_distinct(F.transform("s", lambda x: F.lower(x["value"]))).alias("e"), _distinct_terms("t").alias("c"))
    once = written(once, "pii-once")
    pairs = once.select(F.explode("e").alias("entity"), "c").select("entity", F.explode("c").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("c"))
    inside = once.select(F.explode("c").alias("term")).groupBy("term").agg(F.count("*").alias("n_marked"))
    entities = once.select(F.explode("e").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    df = document_frequency(texts, inside.select("term"), "t").join(inside, "term")
    total = F.lit(float(max(n, 2)))
    chance = (F.col("c") + prior * F.col("n_e") / total) / (F.greatest("df", "c") + prior)
    telling = pairs.join(entities, "entity").join(df, "term").withColumns({"left": -F.log2(chance), "told": F.log2(chance * total / F.col("n_e"))})
    telling = telling.filter((F.col("left") <= generalise) & (F.col("told") >= told))
    telling = written(telling.select("entity", "term", (F.col("left") <= remove).alias("gone"), "df", "n_marked"), "pii-telling")
    # A removed term goes from every text; only one that more texts hold than have spans can stand in any other.
    gone = written(telling.filter("gone").groupBy("term").agg(F.max(F.col("df") > F.col("n_marked")).alias("wide")), "pii-gone")
    own = once.select("__a", "__b", F.explode("e").alias("entity"), "c").select("__a", "__b", "entity", F.explode("c").alias("term"))
    general = own.join(telling.filter(~F.col("gone")).select("entity", "term"), ["entity", "term"]).select("__a", "__b", "term", F.lit(False).alias("gone"))
    held = once.select("__a", "__b", F.explode("c").alias("term")).join(gone.select("term"), "term").select("__a", "__b", "term", F.lit(True).alias("gone"))
    wide = gone.filter("wide").select("term")
    parts = [general, held]
    if not wide.isEmpty():
        small = wide.limit(SMALL + 1).count() <= SMALL
        others = hashes.select("__a", "__b", F.explode(_distinct_terms("t")).alias("term")).join(F.broadcast(wide) if small else wide, "term")
        parts.append(others.join(once.select("__a", "__b"), ["__a", "__b"], "left_anti").select("__a", "__b", "term", F.lit(True).alias("gone")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    kind = F.when(F.max("gone"), "term_removed").otherwise("term_general")
    found = found.groupBy("__a", "__b", "term").agg(kind.alias("kind")).groupBy("__a", "__b").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("m"))
    found = written(found, "pii-found")
    # Few texts without a pattern span hold such a term; the rest are not moved.
    clean = base.filter(F.size("s") == 0)
    if wide.isEmpty():
        clean = clean.withColumn("m", F.lit(None).cast(found.schema["m"].dataType))
    else:
        hits = written(found.join(once.select("__a", "__b"), ["__a", "__b"], "left_anti"), "pii-hits")
        clean = clean.join(F.broadcast(hits) if hits.limit(SMALL + 1).count() <= SMALL else hits, ["__a", "__b"], "left")
    both = marked.join(found, ["__a", "__b"], "left").unionByName(clean)
    terms = f"CASE WHEN m IS NULL THEN filter(s, x -> false) ELSE {_term_spans(_outside(), 'm')} END"
    both = both.select("__row", "t", F.expr(f"CASE WHEN m IS NULL THEN s ELSE array_sort(concat(s, {terms})) END").alias("s"))
    own = "substring(t, x.start + 1, x.end - x.start)"
    shape = "CASE " + " ".join(f"WHEN {own} RLIKE {_quoted(p)} THEN '[{name}]'" for name, p in SHAPES) + " END"
    label = f"CASE x.kind WHEN 'term_removed' THEN '' WHEN 'term_general' THEN {shape} ELSE concat('[', upper(x.kind), ']') END"
    merged = f"""aggregate(s, named_struct('at', 0, 'out', cast(array() AS array<string>)),
      (a, x) -> CASE WHEN x.start < a.at THEN named_struct('at', greatest(a.at, x.end), 'out', a.out)
        ELSE named_struct('at', x.end, 'out', array_append(a.out, concat(substring(t, a.at + 1, x.start - a.at), {label}))) END,
      a -> concat(array_join(a.out, ''), substring(t, a.at + 1, length(t) - a.at)))"""
    done = both.withColumn("o", F.expr(f"CASE WHEN size(s) = 0 THEN t ELSE {merged} END"))
    return done.select(*[F.col("__row").getField(c).alias(c) for c in columns], F.col("s").alias("pii_spans"), F.col("o").alias("sanitised"))


def op8_information_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = {f"n_{k}": F.expr(f"cast(size(filter(pii_spans, x -> x.kind = '{k}')) AS bigint)") for k in KINDS}
    return out.select(
        "doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(F.expr(joined.format(f"filter(pii_spans, x -> x.k < {len(KINDS)})")), 256).alias("base_sha256"),
        F.expr(joined.format("pii_spans")).alias("spans"),
    )
