"""Tool-call linking: calls meet their results by identifier, in a topological order, with checked canonical arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import ranked, table, written

#: What the arguments of a tool must look like: field, type, whether it must be there, least and most (of a number, or
#: of a string's length); no other fields.
SCHEMAS = {
    "user": [("text", "string", True, 1, 20_000), ("turn", "integer", True, 0, None)],
    "system": [("text", "string", True, 1, 4_000), ("turn", "integer", True, 0, None)],
}
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def _errors(tool: Column, arguments: Column, schemas: dict[str, list[tuple]]) -> Column:
    """Array of what is wrong with the arguments of a tool."""
    parsed = F.try_parse_json(arguments)
    fields = F.from_json(arguments, "map<string,variant>")
    known = F.when(parsed.isNull(), F.array(F.lit("not_json"))).when(~F.schema_of_variant(parsed).startswith("OBJECT"), F.array(F.lit("not_object")))
    for name, specs in schemas.items():
        found = []
        for field, kind, required, least, most in specs:
            value = F.try_variant_get(parsed, f"$.{field}", "string")
            type_ = F.schema_of_variant(F.element_at(fields, field))
            size = F.length(value) if kind == "string" else value.try_cast("double")
            wrong = F.when(type_.isNull() | (type_ == "VOID"), F.lit(f"missing:{field}") if required else None).when(type_ != _TYPES[kind], F.lit(f"type:{field}"))
            if least is not None:
                wrong = wrong.when(size < least, F.lit(f"least:{field}"))
            if most is not None:
                wrong = wrong.when(size > most, F.lit(f"most:{field}"))
            found.append(wrong)
        extra = F.transform(F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(s[0]) for s in specs]))), lambda x: F.concat(F.lit("unknown:"), x))
        known = known.when(tool == name, F.concat(F.array_compact(F.array(*found)), extra))
    return known.otherwise(F.array(F.lit("unknown_tool")))


def _repeats(rows: DataFrame, *order: str) -> DataFrame:
    """rows with repeat: 1, 2, ... among those of an identifier, by `order`. Rows are ranked range by range, so that no
    identifier, however common, is a task's."""
    ids = [F.col("conv_id").asc_nulls_first(), F.col("call_id").asc_nulls_first()]
    # Rows equal in all of `order` are alike; which of them is first does not matter.
    all_ = written(ranked(rows.withColumn("__t", F.monotonically_increasing_id()), *ids, *[F.col(c).asc_nulls_first() for c in order], F.col("__t")).drop("__t"), "ranked")
    first = all_.groupBy("conv_id", "call_id").agg(F.min("__rank").alias("__first"), F.count("*").alias("__of")).select(F.col("conv_id").alias("fc"), F.col("call_id").alias("fi"), "__first", "__of")
    met = all_.join(first, F.col("conv_id").eqNullSafe(F.col("fc")) & F.col("call_id").eqNullSafe(F.col("fi")))
    return met.withColumn("repeat", F.col("__rank") - F.col("__first") + 1).drop("fc", "fi", "__rank", "__first")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, list[tuple]] = SCHEMAS) -> DataFrame:
    """One row a call, or a result that no call asked for.

    calls: conv_id, call_id, position, tool, arguments (JSON), depends_on (array of call_id). results: conv_id, call_id,
    position, content. Rows of one identifier are numbered on both sides (repeat: by position, then content), and the first
    call is hashed to the first result, the second to the second; a null identifier is an identifier. n_calls and
    n_results count them. status is linked, unanswered or orphan. arguments_json is canonical: keys sorted, no white space,
    null if it is not JSON. missing counts dependencies that are no calls.

    Calls of a conversation that are sorted by topo_key (an array of positions), then call_id, come after what they lean on
    (the first call of each identifier in depends_on): it is the call's own position, behind the topo_key of a dependency
    that would come later; null on a cycle and for what leans on one. Only conversations with a late dependency go through rounds, as many as late
    dependencies lean on each other. Texts of any length cost what they are long; columns of other names play no part.
    Empty tables give no rows.
    """
    calls = _repeats(calls.select("conv_id", "call_id", "position", "tool", "arguments", "depends_on"), "position", "tool", "arguments", "depends_on").withColumnRenamed("__of", "n_calls")
    calls = written(calls, "calls")
    answers = _repeats(results.select("conv_id", "call_id", "position", "content"), "position", "content").withColumnRenamed("__of", "n_results")
    leaning = calls.select("conv_id", "call_id", "repeat", "position", F.explode(F.array_distinct("depends_on")).alias("needs"))
    known = calls.filter("repeat = 1").select(F.col("conv_id").alias("kc"), F.col("call_id").alias("needs_id"), F.col("position").alias("needs_at"))
    edges = leaning.join(known, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("needs") == F.col("needs_id")), "left").drop("kc")
    late = F.coalesce(F.col("needs_at") >= F.col("position"), F.lit(False))
    per_call = edges.groupBy("conv_id", "call_id", "repeat").agg(F.sum(F.col("needs_id").isNull().cast("int")).alias("missing"), F.max(late).alias("late"))
    per_call = written(per_call, "dependencies")
    c, a, p = calls.alias("c"), answers.alias("a"), per_call.alias("p")

    def same(x: str, y: str) -> Column:
        return F.col(f"{x}.conv_id").eqNullSafe(F.col(f"{y}.conv_id")) & F.col(f"{x}.call_id").eqNullSafe(F.col(f"{y}.call_id")) & (F.col(f"{x}.repeat") == F.col(f"{y}.repeat"))

    both = c.join(p, same("c", "p"), "left").select("c.*", F.coalesce("p.missing", F.lit(0)).cast("long").alias("missing"))
    both = both.withColumn("own", F.array(F.struct(F.coalesce(F.col("position").cast("long"), F.lit(-1)).alias("at"), F.col("call_id").alias("id"))))
    odd = per_call.filter("late").select(F.col("conv_id").alias("oc")).distinct()
    if odd.isEmpty():
        both = both.withColumn("key", F.col("own"))
    else:
        inside = F.col("conv_id").eqNullSafe(F.col("oc"))
        placed = _placed(written(both.filter("repeat = 1").join(odd, inside, "left_semi").select("conv_id", "call_id", "own"), "placed"), edges.filter("needs_id IS NOT NULL").join(odd, inside, "left_semi"))
        # A later call of an identifier is placed behind what it leans on itself.
        behind = edges.filter("needs_id IS NOT NULL").join(placed, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("needs_id") == F.col("pi"))).groupBy("conv_id", "call_id", "repeat").agg(F.max("key").alias("most"), F.max(F.col("key").isNull()).alias("lost"))
        d = behind.alias("d")
        both = both.alias("b").join(d, same("b", "d"), "left").select("b.*", F.when(F.coalesce("lost", F.lit(False)), None).when(F.col("most") >= F.col("own"), F.concat("most", "own")).otherwise(F.col("own")).alias("key"))
    both = both.alias("c")
    return both.join(a, same("c", "a"), "full").select(
        F.coalesce("c.conv_id", "a.conv_id").alias("conv_id"), F.coalesce("c.call_id", "a.call_id").alias("call_id"), F.coalesce("c.repeat", "a.repeat").alias("repeat"), "c.position", "c.tool",
        F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "missing",
        F.when(F.col("n_calls").isNotNull(), _errors(F.col("tool"), F.col("arguments"), schemas)).alias("errors"),
        F.to_json(F.try_parse_json("arguments")).alias("arguments_json"), F.col("a.content").alias("result"), F.transform("key", lambda x: x["at"]).alias("topo_key"),
    )


def _placed(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(pc, pi, key): where each call (conv_id, call_id, own) goes: own, or behind the largest key of what it leans on if that
    is not smaller. Keys grow round by round until none changes; one that would hold a call twice is on a cycle and null."""
    now = calls.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), F.col("own").alias("key"))
    edges = edges.filter("repeat = 1").select("conv_id", "call_id", "needs_id")
    while True:
        at = F.col("conv_id").eqNullSafe(F.col("pc"))
        most = edges.join(now, at & (F.col("needs_id") == F.col("pi"))).groupBy("conv_id", "call_id").agg(F.max("key").alias("most"), F.max(F.col("key").isNull()).alias("lost")).select(F.col("conv_id").alias("mc"), F.col("call_id").alias("mi"), "most", "lost")
        old = now.withColumnRenamed("key", "was")
        met = calls.join(most, F.col("conv_id").eqNullSafe(F.col("mc")) & F.col("call_id").eqNullSafe(F.col("mi")), "left").join(old, at & F.col("call_id").eqNullSafe(F.col("pi")))
        round_ = F.exists("most", lambda x: x == F.col("own")[0])
        key = F.when(F.coalesce("lost", F.lit(False)) | F.coalesce(round_, F.lit(False)), None).when(F.col("most") >= F.col("own"), F.concat("most", "own")).otherwise(F.col("own"))
        new = written(met.select("pc", "pi", "was", key.alias("key")), "placed")
        if new.filter(~F.col("was").eqNullSafe(F.col("key"))).isEmpty():
            return new.drop("was")
        now = new.drop("was")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results: what a user or a system says asks the assistant, whose next turn answers;
    a turn leans on the one two before it, and what a system says on the turn that comes next. The role is the tool, text and turn its arguments."""
    name = F.concat(F.lit("t"), F.col("turn").cast("string"))
    asks = conversations.filter(~F.col("role").eqNullSafe("assistant"))
    before = F.when(F.col("turn") >= 2, F.concat(F.lit("t"), (F.col("turn") - 2).cast("string")))
    after = F.when(F.col("role") == "system", F.concat(F.lit("t"), (F.col("turn") + 1).cast("string")))
    calls = asks.select(
        "conv_id", name.alias("call_id"), F.col("turn").alias("position"), F.col("role").alias("tool"), F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.array_compact(F.array(before, after)).alias("depends_on"),
    )
    said = conversations.filter("role = 'assistant'")
    results = said.select("conv_id", F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_tool_calls(*turns_as_calls(table(spark, sf_dir, "conversations")))
    return out.select(
        "conv_id", "call_id", "repeat", "tool", "status", "n_calls", "n_results", "missing", F.array_join("errors", ",").alias("errors"),
        F.array_join(F.transform("topo_key", lambda x: x.cast("string")), ".").alias("topo_key"), "arguments_json", F.length("result").cast("long").alias("result_chars"),
    )


OP1_SQL = r"""
WITH a AS (
  SELECT conv_id, 't' || turn AS call_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n_calls
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
r AS (
  SELECT conv_id, 't' || (turn - 1) AS call_id, text AS content, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n_results
  FROM conversations WHERE role = 'assistant')
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.k, r.k)::BIGINT AS repeat, c.role AS tool,
  CASE WHEN c.n_calls IS NULL THEN 'orphan' WHEN r.n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(c.n_calls, 0)::BIGINT AS n_calls, coalesce(r.n_results, 0)::BIGINT AS n_results,
  CASE WHEN c.n_calls IS NOT NULL THEN (c.turn >= 2 AND p.turn IS NULL)::INT + (coalesce(c.role = 'system', FALSE) AND x.turn IS NULL)::INT END::BIGINT AS missing,
  CASE WHEN c.n_calls IS NULL THEN NULL WHEN c.role IS NULL OR c.role NOT IN ('user', 'system') THEN 'unknown_tool'
    WHEN c.text IS NULL THEN 'missing:text' WHEN length(c.text) < 1 THEN 'least:text'
    WHEN length(c.text) > CASE c.role WHEN 'user' THEN 20000 ELSE 4000 END THEN 'most:text' ELSE '' END AS errors,
  CASE WHEN x.turn IS NOT NULL THEN x.turn || '.' ELSE '' END || c.turn AS topo_key,
  CASE WHEN c.n_calls IS NOT NULL THEN '{"text":' || to_json(c.text) || ',"turn":' || c.turn || '}' END AS arguments_json, length(r.content)::BIGINT AS result_chars
FROM a c FULL JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id AND r.k = c.k
  LEFT JOIN a p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2 AND p.k = 1 LEFT JOIN a x ON x.conv_id = c.conv_id AND x.turn = c.turn + 1 AND x.k = 1 AND c.role = 'system'
"""
