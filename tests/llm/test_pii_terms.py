"""Terms that give entities away against brute force, at two sizes of a corpus, and long texts full of matches."""

import math
import re
import time
from collections import defaultdict

import pytest

from tidewatch.llm import pii

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def found(spark, texts):
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {(r.doc_id, s.value, s.kind) for r in rows for s in r.pii_spans if s.k == 4}


def by_hand(texts):
    """Counts over distinct texts, pair by pair."""
    once, words = {}, lambda t: {w.lower() for w in re.findall(r"\w+", MAIL.sub(" ", t)) if w != "_"}
    for t in set(texts):
        once[t] = ({m[0].lower() for m in MAIL.finditer(t)}, words(t))
    n, df, de, c = len(once), defaultdict(int), defaultdict(int), defaultdict(int)
    for t, (entities, terms) in once.items():
        for w in {w.lower() for w in re.findall(r"[^\W_]+", t)}:
            df[w] += 1
        for e in entities:
            de[e] += 1
            for w in terms:
                c[e, w] += 1
    general, gone = set(), set()
    for (e, w), k in c.items():
        chance = (k + 4 * de[e] / n) / (max(df[w], k) + 4)
        if -math.log2(chance) <= 4 and math.log2(chance * n / de[e]) >= 2:
            (gone if -math.log2(chance) <= 1.5 else general).add((e, w))
    removed = {w for _, w in gone}
    return {(i, w, "term_removed" if w in removed else "term_general") for i, t in enumerate(texts) for w in once[t][1] if w in removed or any((e, w) in general for e in once[t][0])}


def corpus(n):
    abc = "abcdefghij"
    name = lambda i: "".join(abc[int(d)] for d in f"{i:05d}")
    texts = [f"please write to us about item {name(i)} of list {abc[i % 10]}" for i in range(n)]
    for i in range(9):
        texts[i] = f"Zara Quill at zq@ex.org keeps item {name(i)} in list {abc[i % 4]}"
    texts[20], texts[21], texts[22] = "item of Quill without an address", "write to ob@ex.net about Orla", "Orla and item again"
    return texts + texts[:3]


@pytest.mark.parametrize("n", [300, 1200])
def test_terms_against_brute_force(spark, n):
    assert found(spark, corpus(n)) == by_hand(corpus(n))


def test_verdicts_do_not_drift_with_the_corpus(spark):
    """The same texts among twice and eight times as many others lose the same terms."""
    own = lambda n: {x for x in found(spark, corpus(n)) if x[0] < 23 and len(x[1]) > 1 and x[1] not in ("item", "list")}
    small = own(400)
    assert small == own(800) == own(3200) and {(0, "quill", "term_removed"), (20, "quill", "term_removed"), (21, "orla", "term_general")} <= small


@pytest.mark.parametrize("word", ["12 ; ", "x@y.de, ", "4111111111111111;"])
def test_a_long_text_of_matches_takes_seconds(spark, word):
    n = 800_000 // len(word)
    began = time.perf_counter()
    row = spark.createDataFrame([(1, word * n)], "doc_id long, t string").selectExpr(f"{pii.base_spans()} AS s").selectExpr("size(s) AS n", "try_element_at(s, -1).end AS last").first()
    assert time.perf_counter() - began < 40
    assert (row.n, row["last"]) == ((0, None) if word == "12 ; " else (n, len(word) * n - (2 if word[-1] == " " else 1)))
