"""Language-model scoring with a weighted backoff automaton, built where it is needed from counts of the whole corpus.

States are histories of up to two words that the training documents hold. With c their counts, N tokens and V distinct words
in them, and m a weight, the arc of a word w from the state of the history h carries

    log10((c(h w) + m p(w after h')) / (c(h) + m)),    p(w) = (c(w) + 1) / (N + V + 1) from the root,

where h' is h without its first word. If h w was never seen there is no arc: the failure arc to h' takes over, which carries
log10(m / (c(h) + m)), all that the arcs of h leave. So the words after any history have probabilities that sum to one. A
text is walked from left to right: in each state either the word's arc is taken, or failure arcs until one of its arcs is.

No task holds the whole automaton. Documents are dealt into batches of bounded size. A batch sends, to shards of the
n-grams, the sorted keys of its words and pairs with its training counts; shards add them up and say how often the others
have seen what they share. Only a triple whose two pairs are shared can be shared, so the counts of those alone are exchanged
in a second round. A batch then has the states and arcs that its own texts can reach, as arrays, and walks them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm._common import columns_of, numbered, quoted, table, text_or_empty

_GOLD, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
#: Tokens that no text holds, as they hold white space.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))
#: Bits of a key: 10^8 different words meet by chance half a time; the fewer, the less is sent.
KEY_BITS = 54
#: Words that a walk is cut into, so that many pieces of a batch step at once.
PIECE = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(x: np.ndarray) -> np.ndarray:
    return _mix(x) >> np.uint64(64 - KEY_BITS)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Grams:
    """The n-grams of a batch of texts: sorted keys of each order, and at every token the places of its n-grams among
    them. Keys of words are odd, those of pairs and triples even. Of a text's first token the triple is no n-gram."""

    def __init__(self, texts: list[str]):
        known, parts, starts, at = _Words(), [], [], 0
        for text in texts:
            words = text.encode().lower().split()
            parts += [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), np.array([END])]
            starts.append(at)
            at += len(words) + 1
        word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.starts, self.n = np.array(starts, np.int64), at
        self.lengths = np.diff(np.append(self.starts, at))
        before = np.roll(word, 1)
        before[self.starts] = START
        pair = _mix(_mix(before) + _GOLD + word)
        pair_before = np.roll(pair, 1)
        pair_before[self.starts] = START
        triple = _key(_mix(pair_before + _GOLD) + _GOLD + word) & ~_ONE
        pair = _key(pair) & ~_ONE
        (self.words, self.word), (self.pairs, self.pair), (self.triples, self.triple) = (np.unique(x, return_inverse=True) for x in (_key(word) | _ONE, pair, triple))
        self.deep = np.ones(at, bool)
        self.deep[self.starts] = False

    def trained(self, held_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each word, pair and triple occurs in the batch's training texts."""
        use = np.repeat(~held_out, self.lengths)
        deep = use & self.deep
        return tuple(np.bincount(x[u], minlength=len(k)) for x, u, k in ((self.word, use, self.words), (self.pair, use, self.pairs), (self.triple, deep, self.triples)))


def walk(grams: Grams, counts: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int, n: int, v: int, weight: float) -> np.ndarray:
    """The log10 probability of each text: all pieces of all texts go through the automaton side by side, word by word.

    States: 0 the root, then words, then the start of a text, then pairs. A piece that is not the first of its text starts
    two words early in the root, which leads to the state that the whole text's walk is in.
    """
    one, two, three = (c.astype(np.float64) for c in counts)
    n_words = len(one)
    # Arcs; one that no training text holds is missing, though its weight stands.
    first = np.full(n_words + 1, 0.0)
    first[:n_words] = (one + 1) / (n + v + 1)
    held = np.append(one, texts)  # how often a word, or the start, is a history
    history = np.roll(grams.word, 1)
    history[grams.starts] = n_words
    place = np.empty(len(two), np.int64)  # a token of each pair, of each triple
    place[grams.pair] = np.arange(grams.n)
    second = (two + weight * first[grams.word[place]]) / (held[history[place]] + weight)
    last_of = grams.word[place]
    pair_before = np.roll(grams.pair, 1)
    place = np.empty(len(three), np.int64)
    place[grams.triple] = np.arange(grams.n)
    third = (three + weight * second[grams.pair[place]]) / (two[pair_before[place]] + weight)
    arc1, arc2, arc3 = np.log10(first[:n_words]), np.log10(second), np.log10(third)
    fail1, fail2 = np.log10(weight / (held + weight)), np.log10(weight / (two + weight))
    has2, has3 = two > 0, three > 0
    has3[grams.triple[grams.starts]] = False
    pairs_from = n_words + 2

    pieces = -(-grams.lengths // PIECE)
    text = np.repeat(np.arange(len(pieces)), pieces)
    start = grams.starts[text] + PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(start + PIECE, (grams.starts + grams.lengths)[text])
    at = np.maximum(grams.starts[text], start - 2)
    state = np.where(at == grams.starts[text], n_words + 1, 0)
    total = np.zeros(len(text))
    live = np.arange(len(text))
    while len(live):
        i, s = at[live], state[live]
        word, pair, triple = grams.word[i], grams.pair[i], grams.triple[i]
        in_pair = s >= pairs_from
        took3 = in_pair & has3[triple]
        fails = in_pair & ~took3
        own = np.where(fails, s - pairs_from, 0)
        cost = np.where(fails, fail2[own], 0.0)
        s = np.where(fails, last_of[own] + 1, s)
        in_word = (s > 0) & (s < pairs_from)
        took2 = in_word & has2[pair]
        fails = in_word & ~took2
        cost += np.where(fails, fail1[np.where(fails, s - 1, 0)], 0.0)
        cost += np.where(took3, arc3[triple], np.where(took2, arc2[pair], arc1[word]))
        state[live] = np.where(took3 | took2, pairs_from + pair, np.where(one[word] > 0, word + 1, 0))
        total[live] += np.where(i >= start[live], cost, 0.0)
        at[live] += 1
        live = live[at[live] < end[live]]
    return np.bincount(text, total, len(grams.starts))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys: the first, then differences of as few bytes as the largest takes."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[1:, :width] = steps
    out = wide.view(np.uint64).ravel()
    out[0] = np.frombuffer(data, np.uint64, 1, offset=1)[0]
    return np.cumsum(out, dtype=np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """Small numbers by bytes of like weight, as runs of zeros compress well."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


_REQUEST = "shard int, batch int, keys binary, counts binary"
_ANSWER = "batch int, shard int, kind int, codes binary, n long, v long"


def _messages(batch: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.Table:
    """A row for each shard that has some of the (sorted) keys: shards are ranges of keys."""
    shard = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    has, first = np.unique(shard, return_index=True)
    cut = list(zip(first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True))
    return pa.table({
        "shard": pa.array(has, pa.int32()), "batch": pa.array([batch] * len(has), pa.int32()),
        "keys": pa.array([_packed(keys[a:b]) for a, b in cut], pa.binary()), "counts": pa.array([_planes(counts[a:b]) for a, b in cut], pa.binary()),
    })


def _grams_of(docs: pa.Table) -> tuple[Grams, np.ndarray]:
    return Grams(docs.column("t").to_pylist()), docs.column("held_out").to_numpy()


def _words_and_pairs(g: Grams) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([g.words, g.pairs])
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def _asking(shards: int):
    """A batch's words and pairs, to the shards."""

    def run(docs: pa.Table) -> pa.Table:
        g, held_out = _grams_of(docs)
        one, two, _ = g.trained(held_out)
        keys, order = _words_and_pairs(g)
        return _messages(docs.column("batch")[0].as_py(), keys, np.concatenate([one, two])[order], shards)

    return run


def _answering(kind: int):
    """A shard's answers, in the order of what each batch asked: 0 if no other batch holds the n-gram, else 1 more than the
    training count of the others."""

    def run(requests: pa.Table) -> pa.Table:
        asked = [_unpacked(x.as_py()) for x in requests.column("keys")]
        own = [_numbers(x.as_py()) for x in requests.column("counts")]
        _, place, times = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        total = np.bincount(place, np.concatenate(own)).astype(np.int64)
        codes = np.where(times[place] == 1, 0, total[place] - np.concatenate(own) + 1)
        rows = requests.num_rows
        return pa.table({
            "batch": requests.column("batch"), "shard": requests.column("shard"), "kind": pa.array([kind] * rows, pa.int32()),
            "codes": pa.array([_planes(x) for x in np.split(codes, np.cumsum([len(x) for x in asked])[:-1])], pa.binary()),
            "n": pa.nulls(rows, pa.int64()), "v": pa.nulls(rows, pa.int64()),
        })

    return run


def _counting(requests: pa.Table) -> pa.Table:
    """A shard's part of N and V."""
    keys, place = np.unique(np.concatenate([_unpacked(x.as_py()) for x in requests.column("keys")]), return_inverse=True)
    total = np.bincount(place, np.concatenate([_numbers(x.as_py()) for x in requests.column("counts")]))[(keys & _ONE) == 1]
    return pa.table({"n": pa.array([int(total.sum())], pa.int64()), "v": pa.array([int((total > 0).sum())], pa.int64())})


def _codes(answers: pa.Table, kind: int) -> np.ndarray:
    shard, kinds = answers.column("shard").to_numpy(), answers.column("kind").to_numpy()
    own = np.flatnonzero(kinds == kind)
    parts = [_numbers(answers.column("codes")[int(i)].as_py()) for i in own[np.argsort(shard[own], kind="stable")]]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _known(g: Grams, held_out: np.ndarray, answers: pa.Table):
    """Counts of words, pairs and (the batch's own) triples, and which triples others may hold."""
    one, two, three = g.trained(held_out)
    _, order = _words_and_pairs(g)
    code = np.empty(len(order), np.int64)
    code[order] = _codes(answers, 1)
    more = np.maximum(0, code - 1)
    shared = code[len(one) :] > 0
    open_ = np.zeros(len(three), bool)
    before = np.roll(g.pair, 1)
    open_[g.triple[g.deep & shared[g.pair] & shared[before]]] = True
    return one + more[: len(one)], two + more[len(one) :], three, open_


def _asking_again(shards: int):
    """A batch's triples that others may hold, to the shards."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g, held_out = _grams_of(docs)
        _, _, three, open_ = _known(g, held_out, answers)
        return _messages(docs.column("batch")[0].as_py(), g.triples[open_], three[open_], shards)

    return run


def _scoring(weight: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        g, held_out = _grams_of(docs)
        one, two, three, open_ = _known(g, held_out, answers)
        three[open_] += np.maximum(0, _codes(answers, 2) - 1)
        n, v, texts = (answers.column(c).combine_chunks().drop_null()[0].as_py() for c in ("n", "v", "shard_texts"))
        base = np.log10((one[g.word] + 1) / (n + v + 1))
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(g.lengths, pa.int64()),
            "n_known": pa.array(np.add.reduceat((one[g.word] > 0).astype(np.int64), g.starts), pa.int64()), "train_tokens": pa.array([n] * docs.num_rows, pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, g.starts)), "score": pa.array(walk(g, (one, two, three), texts, n, v, weight)),
        })

    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weight: float = 8.0, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose id's CRC-32 is 2 modulo 7 are held out and teach nothing; a null id is not held out. Null and empty
    texts are one END. Repeated rows count and are scored each, and are dealt over all batches. A batch holds about
    batch_bytes of text, or one longer text. An empty table gives no rows; other columns play no part. A batch sends no
    message to a shard that has nothing of it, so that there are never more messages than n-grams that batches hold.
    """
    bytes_ = docs.agg(F.sum(F.octet_length(text_or_empty(text)) + 8)).first()[0] or 0
    batches = max(12, math.ceil(bytes_ / batch_bytes))
    shards = 2 * batches
    rows = numbered(docs.select(F.struct(quoted(doc_id).alias("doc_id"), text_or_empty(text).alias("t")).alias("__row")))
    out = F.coalesce(F.pmod(F.crc32(F.col("__row.doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    batch = F.pmod(F.xxhash64("__h", "__g", "__j"), F.lit(batches)).cast("int").alias("batch")
    dealt = rows.select("__row.doc_id", "__row.t", out.alias("held_out"), batch).repartition(batches, "batch")
    asked = dealt.groupBy("batch").applyInArrow(_asking(shards), _REQUEST).groupBy("shard")
    answers = asked.applyInArrow(_answering(1), _ANSWER)
    again = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_asking_again(shards), _REQUEST)
    more = again.groupBy("shard").applyInArrow(_answering(2), _ANSWER)
    totals = asked.applyInArrow(_counting, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    # Every text ends once, so a start was seen as often as there are training texts.
    train = docs.agg(F.count(F.when(~F.coalesce(F.pmod(F.crc32(quoted(doc_id).cast("string")), F.lit(7)) == 2, F.lit(False)), 1))).first()[0]
    each = totals.select(F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), F.lit(None).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("codes"), "n", "v")
    all_ = answers.unionByName(more).unionByName(each).withColumn("shard_texts", F.when(F.col("kind") == 0, F.lit(train).cast("long")))
    kind = dict(dealt.dtypes)["doc_id"]
    return dealt.groupBy("batch").cogroup(all_.groupBy("batch")).applyInArrow(
        _maybe_empty(_scoring(weight)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _maybe_empty(run):
    """Batches without documents have only the totals."""

    def checked(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if docs.num_rows:
            return run(docs, answers)
        none = pa.array([], pa.float64())
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), **{c: none.cast(pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, "base_score": none, "score": none})

    return checked


def op9_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, i) ORDER BY i) AS tab FROM range(256) t(i)),
w AS (
  SELECT doc_id,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT), lambda c, x: xor(tab[(xor(c, x) % 256) + 1], c // 256), 4294967295::BIGINT), 4294967295::BIGINT) % 7 = 2 AS held_out,
    list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' end') AS w
  FROM documents, tab),
t AS (SELECT doc_id, held_out, unnest(w) AS w, unnest(list_prepend(' start', w[1:len(w) - 1])) AS h, unnest(list_prepend(NULL, list_prepend(' start', w))[1:len(w)]) AS g FROM w),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
b AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1, 2),
r AS (SELECT g, h, w, count(*) AS c FROM t WHERE NOT held_out AND g IS NOT NULL GROUP BY 1, 2, 3),
z AS (SELECT sum(c) AS n, count(*) AS v FROM u),
s AS (
  SELECT t.doc_id, t.held_out, coalesce(u.c, 0) AS c, coalesce(b.c, 0) AS cb, coalesce(hu.c, 0) AS ch, coalesce(r.c, 0) AS cr, coalesce(hb.c, 0) AS chb
  FROM t LEFT JOIN u ON u.w = t.w LEFT JOIN b ON b.h = t.h AND b.w = t.w LEFT JOIN u hu ON hu.w = CASE WHEN t.h = ' start' THEN ' end' ELSE t.h END
    LEFT JOIN r ON r.g = t.g AND r.h = t.h AND r.w = t.w LEFT JOIN b hb ON hb.h = t.g AND hb.w = t.h)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, sum((c > 0)::INT)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens,
  sum(log10((c + 1)::DOUBLE / (n + v + 1))) AS base_score,
  sum(log10((cr + 8.0::DOUBLE * (cb + 8.0::DOUBLE * (c + 1) / (n + v + 1)) / (ch + 8.0::DOUBLE)) / (chb + 8.0::DOUBLE))) AS score
FROM s, z GROUP BY 1, 2
"""
