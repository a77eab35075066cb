"""Alignment of tokens against whole texts encoded in one piece, and groups from sets of ends."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidewatch.llm import align as A

PAIR = A.pair_of(A.BYTE_LEVEL, A.PIECES)
ODD = [None, "", " ", "a", "  lead", "trail  ", "a  b", "x\ty\nz", "▁ mark ▁a", "<|endoftext|> <s> </s>", "né ñ 日本語 テスト", "don't we'll", "…… —— a", "soft­hy phen", "é ́x", "\x00 \x7f", "🙂🙂 🙂", "1234567 89", "ﬁ ½ ①", "ok", "ok"]


def by_hand(texts):
    """Rows of all texts, each encoded as a whole, groups by the sets of ends, links by comparing ranges."""
    found = []
    for text in texts:
        ids = PAIR.encoded(text) if text else None
        a, b = ids or ([], [])
        ends = [[], []]
        for k, (tokens, size) in enumerate(((a, PAIR.bytes_a), (b, PAIR.bytes_b))):
            at = 0
            for i in tokens:
                at += len(size[i])
                ends[k].append(at)
        groups, held = [], [[], []]
        linked = []
        for e in sorted(set(ends[0]) & set(ends[1])):
            lo = groups[-1][0] if groups else 0
            held = [[(i, ([0, *x])[j], x[j]) for j, i in enumerate(t) if lo < x[j] <= e] for t, x in ((a, ends[0]), (b, ends[1]))]
            groups.append((e, ",".join(str(i) for i, *_ in held[0]) + "|" + ",".join(str(i) for i, *_ in held[1])))
            linked += [(i, j) for i, s, t in held[0] for j, u, v in held[1] if s < v and u < t]
        found.append((len(a), len(b), len(groups), linked, hashlib.sha256(";".join(g for _, g in groups).encode()).hexdigest() if a else ""))
    count = Counter(p for *_, linked, _ in found for p in set(linked))
    best = Counter()
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(na, nb, ng, len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), h) for na, nb, ng, x, h in found]


def rows_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumnRenamed("doc_id", "doc.id")
    out = A.align(docs, "doc.id").collect()
    assert len(out) == len(texts)
    return [tuple(r)[1:] for r in sorted(out, key=lambda r: r.doc_id)]


def test_odd_texts(spark):
    assert rows_of(spark, ODD) == by_hand(ODD)


def test_documents_in_small_slices(spark, monkeypatch):
    texts = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()
    texts = [t for t in texts if t is None or len(t) < 900] + ["word" * 300, "a b " * 200]
    monkeypatch.setattr(A, "SLICE", 5_000)
    got = rows_of(spark, texts)
    assert got == by_hand(texts) and sum(r[3] for r in got) > 5_000


def test_chunks_are_encoded_as_in_the_whole_text():
    for text in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.dropna().tolist()[:400]:
        chunks, whole = A.Chunks(), PAIR.encoded(text)
        which = [chunks[c] for c in A._CUT.split(text)] if text else []
        a, b, sizes = chunks._encoded(PAIR)
        to = np.cumsum(sizes, axis=0)
        if text and whole:
            rows = chunks.row[which]
            assert tuple([i for r in rows for i in ids[t[r] - n[r] : t[r]].tolist()] for ids, t, n in zip((a, b), to.T, sizes.T)) == whole


@pytest.mark.parametrize("seed", range(30))
def test_groups_are_the_intervals_between_common_ends(seed, monkeypatch):
    monkeypatch.setattr(A, "PROBES", 1 + seed % 4)
    rng = random.Random(seed)
    n = rng.randint(1, 400)
    a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n - 1)), n}) for _ in range(2))
    made = A.groups(np.array(a), np.array(b), np.array([[0, len(a), 0, len(b)]])).tolist()
    assert [a[g[1] - 1] for g in made] == sorted(set(a) & set(b)) and all(a[g[1] - 1] == b[g[3] - 1] for g in made)
    assert [g[0] for g in made] == [0, *[g[1] for g in made[:-1]]] and [g[2] for g in made] == [0, *[g[3] for g in made[:-1]]]
    spans = lambda x: list(zip([0, *x], x))
    wanted = [(i, j) for i, (s, t) in enumerate(spans(a)) for j, (u, v) in enumerate(spans(b)) if s < v and u < t]
    assert list(zip(*[x.tolist() for x in A.links(np.array(a), np.array(b))])) == wanted


def test_a_long_interval_without_a_cut_is_one_group():
    a, b = np.arange(2, 200_002, 2), np.append(np.arange(1, 200_000, 2), 200_000)
    assert A.groups(a, b, np.array([[0, 100_000, 0, 100_001]])).tolist() == [[0, 100_000, 0, 100_001]]


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
