"""Decontamination: the positional index and its search against a scan of every text."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidewatch.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def scanned(text, items, width, slack=0):
    """n_words, hit places, items and near items of a text."""
    w, hit, found, near = words(text), set(), set(), set()
    for item, passage in items:
        p = words(passage)
        for window in D.windows_of(p, width):
            for s in range(-slack, len(w) + slack):
                if tuple(w[s : s + len(window)]) == window and s >= 0:
                    hit |= set(range(s, s + len(window)))
                    found.add(item)
                if slack and all(x in w[max(0, s + j - slack) : max(0, s + j + slack + 1)] for j, x in enumerate(window)):
                    near.add(item)
    return len(w), hit, found - {None}, near - found - {None}


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    vocabulary = ["Ab", "b2", "c", "dé", "e", "ff", "日本", "h"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for i in range(20)]
    items += [("20", None), ("21", ""), ("22", "..."), (None, "only the nameless one"), ("0", items[0][1]), ("23", "to be or not to be that is the question here")]
    texts = [None, "", " - ", "Ab", *(rng.choice([" ", ", ", "\n\x01"]).join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60))]
    texts += ["x " * 5000 + "To be, or NOT to be: that is the question here" + " y" * 5000, "to be or maybe not to be that is the question here", "only the nameless one", items[3][1] + " z " + items[4][1]]
    return [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[7], 2), (7, texts[7], 3)], items


@pytest.mark.parametrize(("width", "slack"), [(3, 0), (3, 1), (10, 2)])
def test_against_a_scan(spark, tables, width, slack, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 3000)
    docs, items = tables
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string, segment int"))
    found = D.search(index, spark.createDataFrame(items, "item_id string, text string"), width=width, slack=slack)
    got = sorted(((r.doc_id, r.n_words, frozenset(i for a, b in r.hits for i in range(a, b)), frozenset(r["items"]), frozenset(r.near_items)) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    wanted = sorted(((i, n, frozenset(h), frozenset(f), frozenset(m)) for i, t, _ in docs for n, h, f, m in [scanned(t, items, width, slack)]), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == wanted and any(r[3] for r in got) and (not slack or any(r[4] for r in got))


def test_many_groups_of_items_give_what_one_gives(spark, tables, monkeypatch):
    docs, items = tables
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string, segment int"))
    table = spark.createDataFrame(items, "item_id string, text string")
    plain = lambda df: sorted(map(str, (r.asDict() for r in df.collect())))
    one = plain(D.search(index, table, width=3, slack=1))
    monkeypatch.setattr(D, "TOGETHER", 100)
    assert plain(D.search(index, table, width=3, slack=1)) == one
    monkeypatch.setattr(D, "SENT", 0)
    assert plain(D.search(index, table, width=3, slack=1)) == one


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.search(D.build_index(docs), items).count() == 0
    one = D.search(D.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string")), items).collect()
    assert [(r.doc_id, r.n_words, r.hits, r["items"]) for r in one] == [(1, 2, [], [])]


def test_index_holds_every_word(spark):
    docs = [(1, "b a b"), (2, None), (3, "c b")]
    r = D.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), gap=10).collect()[0]
    places = np.frombuffer(r.places, np.int32)
    ends = np.cumsum(r.counts)
    assert {t: places[e - c : e].tolist() for t, c, e in zip(r.terms, r.counts, ends)} == {"b": [0, 2, 24], "a": [1], "c": [23]}
    assert list(r.doc_ids) == [1, 2, 3] and list(r.n_words) == [3, 0, 2]


def test_segments_are_stored_and_read_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT", 1 << 18)
    rng = random.Random(5)
    texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(8000)) for _ in range(60)]
    index = D.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    kept = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    rows = [m.row_group(i).num_rows for m in kept for i in range(m.num_row_groups)]
    assert sum(rows) == index.count() > 10 and max(rows) <= 2


def test_windows_must_fit_the_gap(spark):
    index = D.build_index(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    with pytest.raises(ValueError):
        D.search(index, spark.createDataFrame([(1, "a")], "item_id long, text string"), width=60, slack=3)
