"""The trie of conversations against one built from the rebuilt conversations themselves."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, f1 string"


def built(rows):
    stored = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            stored[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    stored = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in stored.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = stored.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(n) == len(node) + 1 for n in below), len(leaves), saved,
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def tried(spark, rows, **more):
    conv = F.col("conv_id")
    found = T.prefix_trie(spark.createDataFrame(rows, SCHEMA), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, **more).collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for conv in [*range(0, 12), *range(100, 112), *range(205, 212), 300, 317]:
        for turn in range(rng.choice([1, 2, 4, 7, 9])):
            out.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "né", "", None, "日本 語", "hi "]), turn, "x"))
    for conv in range(500, 540):  # copies of one conversation
        out += [(conv, j, "user", f"copy {j}", 0, None) for j in range(8)]
    out += [(7, None, "user", "first of all", 0, None), (7, 3, "user", "tie", 0, None), (7, 3, "system", "tie", 0, None), (9, 1, "user", "again", 0, None), (9, 1, "user", "again", 0, None)]
    out += [(None, 1, "user", "nobody's", 0, None), (650, 0, "user", "long " * 30_000, 0, None), (651, 0, "user", "long " * 30_000 + "!", 0, None)]
    return out + [(300, j, "user", f"turn {j % 3}", 0, None) for j in range(10, 400)]


def test_against_rebuilt_conversations(spark, rows):
    assert tried(spark, rows) == built(rows)


def test_collisions_are_found_and_mended(spark, rows, monkeypatch):
    salts, plain, primes = [], T.fingerprints, T.MODULI

    def poor_at_first(turns, salt):
        salts.append(salt)
        monkeypatch.setattr(T, "MODULI", primes if salt else (2, 41))
        return plain(turns, salt)

    monkeypatch.setattr(T, "fingerprints", poor_at_first)
    some = [r for r in rows if r[0] is None or r[0] < 220 or 500 <= r[0] < 505]
    assert tried(spark, some) == built(some)
    assert salts == [0, 2]


def test_small_chunks_give_the_same_digests(spark, rows, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 4)
    some = [r for r in rows if r[0] and 500 <= r[0] < 540]
    assert tried(spark, some) == built(some)


def test_no_turns_no_nodes_and_heads_have_a_limit(spark, rows):
    assert tried(spark, []) == []
    with pytest.raises(Exception, match="more than 2 turns"):
        tried(spark, rows, most=2)
    alone = T.prefix_trie(spark.createDataFrame([(1, 0, "u", "a", 0, ""), (2, 0, "u", "a", 0, "")], SCHEMA)).collect()
    assert sorted((r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in alone) == [(0, 2, 1, 1), (1, 2, 1, 1)]
