"""The trie of conversations' beginnings, without ever writing a rebuilt conversation.

A rebuilt conversation is the head of a base conversation followed by its own suffix. Both are known by fingerprints of a
monoid: a run of n turns with numbers t has (n, sum of t_i P^i mod M), and two runs combine as
(n, f) * (m, g) = (n + m, f + P^n g). So the fingerprint of each rebuilt prefix comes from products stored once a turn.

1. Stored turns are dealt by ranges of (conversation, order); each range is multiplied up, then what comes before it.
2. A conversation is a member of its base's nodes by reference, and of one node for each turn of its own suffix.
3. Nodes are groups of equal depth and fingerprint. Each group is verified: all its members' parents must be one group, and
   the turns they refer to must have one digest (SHA-256 of role and text). Should two prefixes collide, all is done again
   with other numbers; what is returned never depends on them.
4. A node belongs to its smallest member. The nodes of a conversation are the end of its path, so that sums over subtrees
   are sums over members less a running sum along one path; no step goes level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm._common import quoted, table, written

#: Two primes below 2^31 and the powers' bases: a product of two remainders fits a long.
MODULI, BASES = (2147483647, 2147483629), (1103515245, 1566083941)
#: Bytes of joined ids that go to a node's digest in a row.
CHUNK = 16 << 10
NODE = ["depth", "f1", "f2"]


def _power(base: int, exponent: str, modulus: int) -> str:
    """SQL of base ^ exponent mod modulus, for exponents below 2^31."""
    squares = [base]
    for _ in range(30):
        squares.append(squares[-1] * squares[-1] % modulus)
    each = ", ".join(f"{x}L" for x in squares)
    return f"aggregate(filter(transform(array({each}), (x, k) -> IF((shiftright(CAST({exponent} AS BIGINT), k) & 1) = 1, x, 0L)), x -> x > 0), 1L, (a, x) -> a * x % {modulus}L)"


def fingerprints(turns: DataFrame, salt: int) -> DataFrame:
    """turns (conv_id, turn, role, text, none null but turn) as (conv_id, place, key, n_chars, e1, e2, i1, i2): a turn's place
    in its conversation, its digest and code points, and the products of the turns before it and up to it.

    Turns of equal number come by role, then by digest. A conversation may span ranges, and so tasks.
    """
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    number = [(F.pmod(F.xxhash64(F.lit(salt + k), "role", "text"), F.lit(m - 1)) + 1).alias(f"t{k + 1}") for k, m in enumerate(MODULI)]
    slim = turns.select("conv_id", "turn", "role", digest.alias("key"), F.length("text").cast("long").alias("n_chars"), *number)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    dealt = written(slim.repartitionByRange("conv_id", *order).withColumn("b", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("b", "conv_id").orderBy(*order)
    local = dealt.withColumn("j", F.row_number().over(inside) - 1)
    for k, m in enumerate(MODULI, 1):
        local = local.withColumn(f"w{k}", F.expr(_power(BASES[k - 1], "j", m))).withColumn(f"v{k}", F.col(f"t{k}") * F.col(f"w{k}") % m)
        local = local.withColumn(f"s{k}", F.coalesce(F.sum(f"v{k}").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % m)
    local = written(local, "local")
    parts = local.groupBy("conv_id", "b").agg(F.count("*").alias("n"), *[(F.sum(f"v{k}") % m).alias(f"f{k}") for k, m in enumerate(MODULI, 1)])
    before = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    for k, m in enumerate(MODULI, 1):
        parts = parts.withColumn(f"p{k}", F.expr(_power(BASES[k - 1], "start", m)))
        parts = parts.withColumn(f"o{k}", F.coalesce(F.sum(F.col(f"p{k}") * F.col(f"f{k}") % m).over(before), F.lit(0)) % m)
    out = local.join(parts.select("conv_id", "b", "start", "p1", "p2", "o1", "o2"), ["conv_id", "b"])
    both = [((F.col(f"o{k}") + F.col(f"p{k}") * s) % m).alias(f"{name}{k}") for name in "ei" for k, m in enumerate(MODULI, 1) for s in [F.col(f"s{k}") if name == "e" else (F.col(f"s{k}") + F.col(f"v{k}")) % m]]
    return written(out.select("conv_id", (F.col("start") + F.col("j")).alias("place"), "key", "n_chars", *both), "products")


def memberships(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """(conv_id, depth, f1, f2, p1, p2, key, n_chars, ends): which conversation has which prefix, p the prefix less its last
    turn, key and n_chars null where the last turn is a base's. base and head are expressions over conv_id; head is at most `most`."""
    firsts = F.transform(F.sort_array(F.collect_list(F.when(F.col("place") < most, F.struct("place", "i1", "i2")))), lambda x: F.struct(x["i1"].alias("i1"), x["i2"].alias("i2")))
    known = written(turns.groupBy("conv_id").agg(F.count("*").alias("n"), firsts.alias("firsts")), "conversations")
    own = known.withColumns({"base": base, "head": head})
    own = own.withColumn("head", F.when(F.col("base") == F.col("conv_id"), 0).when(F.col("head") > most, F.raise_error(F.lit(f"a head of more than {most} turns"))).otherwise(F.col("head")))
    heads = known.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("firsts").alias("base_firsts"))
    convs = own.join(heads, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))).cast("int"))
    zero = F.struct(F.lit(0).cast("long").alias("i1"), F.lit(0).cast("long").alias("i2"))
    convs = convs.select(
        "conv_id", "head", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("total"),
        F.when(F.col("taken") > 0, F.slice("base_firsts", F.lit(1), F.col("taken"))).alias("borrowed"),
        F.when(F.col("taken") > 0, F.get("base_firsts", F.col("taken") - 1)).otherwise(zero).alias("h"),
        F.when(F.col("head") == 0, zero).otherwise(F.get("firsts", (F.col("head") - 1).cast("int"))).alias("cut"),
        *[F.get(F.array(*[F.lit(pow(pow(b, -1, m), j, m)) for j in range(most + 1)]), (F.col("head") - F.col("taken")).cast("int")).alias(f"shift{k}") for k, (m, b) in enumerate(zip(MODULI, BASES), 1)],
    )
    convs = written(convs, "rebuilt")
    suffix = turns.join(convs.drop("borrowed"), "conv_id").filter("place >= head")
    depth = F.col("taken") + F.col("place") - F.col("head") + 1
    product = {f"{to}{k}": (F.col(f"h.i{k}") + F.pmod(F.col(f"{of}{k}") - F.col(f"cut.i{k}"), F.lit(m)) * F.col(f"shift{k}")) % m for to, of in (("f", "i"), ("p", "e")) for k, m in enumerate(MODULI, 1)}
    suffix = suffix.select("conv_id", depth.alias("depth"), *[c.alias(n) for n, c in product.items()], "key", "n_chars", (depth == F.col("total")).alias("ends"))
    nothing = [F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("n_chars")]
    lent = convs.filter("taken > 0").select("conv_id", "total", "borrowed", F.posexplode("borrowed").alias("at", "f"))
    last = F.get("borrowed", F.col("at") - 1)
    lent = lent.select(
        "conv_id", (F.col("at") + 1).cast("long").alias("depth"), F.col("f.i1").alias("f1"), F.col("f.i2").alias("f2"), *[F.coalesce(last[f"i{k}"], F.lit(0)).alias(f"p{k}") for k in (1, 2)], *nothing,
        (F.col("at") + 1 == F.col("total")).alias("ends"),
    )
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("f1", "f2")], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], *nothing, (F.col("total") == 0).alias("ends"))
    return written(suffix.unionByName(lent).unionByName(root), "members")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of nodes at which conversations end. Ids are joined where ranges of them lie; a node's
    digest then reads its chunks in order, one at a time."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": [node[0]], "f1": [node[1]], "f2": [node[2]], "first": [first], "ids": [",".join(ids)]})

        for batch in batches:
            out = []
            for *key, conv in zip(*[batch.column(c).to_pylist() for c in (*NODE, "conv_id")], strict=True):
                if ids and (key != node or size > CHUNK):
                    out.append(chunk())
                    ids = []
                if not ids:
                    node, first, size = key, conv, 0
                ids.append(str(conv))
                size += len(ids[-1])
            yield from out
        if ids:
            yield chunk()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done: dict[str, list] = {"depth": [], "f1": [], "f2": [], "ends_sha256": []}

        def close() -> None:
            for c, v in zip(done, (*node, state.hexdigest()), strict=True):
                done[c].append(v)

        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if key != node:
                    if node:
                        close()
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(done["depth"]) > 10_000:
                yield pa.RecordBatch.from_pydict(done)
                done = {c: [] for c in done}
        if node:
            close()
        if done["depth"]:
            yield pa.RecordBatch.from_pydict(done)

    chunks = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id").mapInArrow(joined, "depth long, f1 long, f2 long, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(hashed, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Column | None = None, head: Column | None = None, most: int = 5, salt: int = 0) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    turns holds conv_id, turn, role and text; other columns play no part. A conversation is rebuilt from the first `head`
    turns of conversation `base` (expressions over conv_id; head at most `most`, base itself where head is not given) and its
    own turns after its first `head`. Turns are ordered by number (null first), equal ones by role and digest; a null role or
    text is empty; repeated rows are turns each; turns without a conv_id belong to no conversation and are left out. A base
    that is absent lends nothing. Depth 0 is the root, which has all conversations, also those without turns; an empty table
    has no nodes. saved_tokens counts, for each node of the subtree, the code points of its last turn once for each member but one.
    """
    plain = turns.filter(quoted("conv_id").isNotNull()).select(quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").alias("turn"), *[F.coalesce(quoted(c), F.lit("")).alias(c) for c in ("role", "text")])
    base, head = (F.col("conv_id"), F.lit(0)) if base is None or head is None else (base, head)
    members = memberships(fingerprints(plain, salt), base.cast("long"), head.cast("long"), most)
    checked = [x for c in ("p1", "p2", "key") for x in (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"))]
    grouped = members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_chars").alias("n_chars"), *checked)
    grouped = grouped.withColumn("collided", F.coalesce(F.expr("least_p1 <> most_p1 OR least_p2 <> most_p2 OR least_key <> most_key"), F.lit(False)))
    nodes = written(grouped.select(*NODE, F.col("least_p1").alias("p1"), F.col("least_p2").alias("p2"), "conv_id", "n_convs", F.coalesce((F.col("n_convs") - 1) * F.col("n_chars"), F.lit(0)).alias("saves"), "collided"), "nodes")
    if not nodes.filter("collided").isEmpty():
        return prefix_trie(turns, base, head, most, salt + len(MODULI))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.drop("collided").join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # Along a conversation's own nodes: place 0 is where it leaves a smaller one's path, `before` what the nodes above save.
    dealt = written(nodes.repartitionByRange("conv_id", "depth").withColumn("b", F.spark_partition_id()), "paths")
    up = Window.partitionBy("b", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = dealt.groupBy("conv_id", "b").agg(F.sum("saves").alias("s"), F.count("*").alias("n"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    offsets = parts.select("conv_id", "b", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    along = dealt.withColumns({"before": F.coalesce(F.sum("saves").over(up), F.lit(0)), "at": F.count("*").over(up)}).join(offsets, ["conv_id", "b"])
    along = along.select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children", (F.col("before") + F.col("s0")).alias("before"), (F.col("at") + F.col("n0")).alias("at"))
    gains = parts.groupBy("conv_id").agg(F.sum("s").alias("gain"), F.sum("leaves").alias("leaves"))
    sums = members.select(*NODE, "conv_id").join(gains, "conv_id").groupBy(*NODE).agg(F.sum("gain").alias("gain"), F.sum("leaves").alias("n_leaves"))
    along = written(along.join(sums, NODE), "along")
    inner = along.filter("at > 0 OR depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    parents = along.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    leaving = along.filter("at = 0 AND depth > 0").join(parents.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), "parent_conv_id"), ["depth", "p1", "p2"])
    named = inner.unionByName(leaving).join(_digests(members.filter("ends")), NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("gain") - F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)


OP11_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, i) ORDER BY i) AS tab FROM range(256) t(i)),
s AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, sha256(concat(length(r), ':', r, x))) - 1 AS i FROM s),
b AS (
  SELECT c, count(*) AS n, c - c % 100 AS base,
    xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT), lambda c, x: xor(any_value(tab)[(xor(c, x) % 256) + 1], c // 256), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h
  FROM t, tab GROUP BY c),
l AS (SELECT b.c, b.h, least(b.h, coalesce(z.n, 0)) AS hb, b.base FROM b LEFT JOIN b z ON z.c = b.base),
q AS (
  SELECT l.c, t.i + 1 AS d, t.r, t.x FROM l JOIN t ON t.c = l.base AND t.i < l.hb
  UNION ALL SELECT l.c, l.hb + t.i - l.h + 1, t.r, t.x FROM l JOIN t ON t.c = l.c AND t.i >= l.h),
p AS (SELECT c, d, length(x) AS chars, sha256(string_agg(concat(length(r), ':', r, length(x), ':', x), '') OVER (PARTITION BY c ORDER BY d)) AS k FROM q),
m AS (SELECT c, d, k, chars, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '') AS pk FROM p UNION ALL SELECT c, 0, '', 0, NULL FROM b),
e AS (SELECT d, k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS e FROM (SELECT c, d, k, max(d) OVER (PARTITION BY c) AS total FROM m) WHERE d = total GROUP BY 1, 2),
n AS (SELECT d, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saves FROM m GROUP BY 1, 2),
a AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN a USING (d, k)),
u AS (SELECT m.d, m.k, sum(w.saves) AS saved, sum((w.n_children = 0)::INT) AS leaves FROM m JOIN w ON w.conv_id = m.c AND w.d >= m.d GROUP BY 1, 2)
SELECT w.conv_id, w.d::BIGINT AS depth, g.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, coalesce(e.e, sha256('')) AS ends_sha256
FROM w JOIN u USING (d, k) LEFT JOIN n g ON g.d = w.d - 1 AND g.k = w.pk LEFT JOIN e ON e.d = w.d AND e.k = w.k
"""
