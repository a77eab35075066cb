"""Corpus operators against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ann, bpe, chat_tools, gbt_quality, minhash, mixing, ngram_lm, pii, sharding, weak_supervision
from tidewatch.llm._common import words

TEXT = "the quick brown fox jumps over the lazy dog and runs far away from here today while birds sing loudly"
ROWS = [(1, TEXT, "a"), (2, TEXT, "b"), (3, TEXT + " indeed", None), (4, None, "a"), (5, "", "b"), (None, "one", "a"), (6, "mail x.y@ex.am.org or call +44 20 7946 0958 now", "a"), (6, "mail x.y@ex.am.org or call +44 20 7946 0958 now", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "kept": F.lit(7), "w": F.lit(1)})


def test_bpe_round_trip(docs):
    for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    long = "word é " * 30_000
    assert "".join(bpe.pieces(long)) == long
    e = bpe.encoding(bpe.RANKS)
    assert bpe.encode(e, long) == e.encode_ordinary(long)


def test_bpe_round_trip_in_one_pass(docs):
    one = sorted(bpe.bpe_round_trip(docs.withColumn("n_tokens", F.lit("x"))).select("doc_id", "token_ids", "n_tokens", "round_trip").collect(), key=str)
    two = bpe.bpe_decode(bpe.bpe_encode(docs))
    two = sorted(two.select("doc_id", "token_ids", "n_tokens", (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("round_trip")).collect(), key=str)
    assert one == two and all(r.round_trip for r in one)
    assert "text" not in bpe.bpe_round_trip(docs).columns and bpe.bpe_round_trip(docs.filter("false")).count() == 0


def test_near_duplicates(docs):
    got = {(r.doc_id, r.text): (r.component_id, r.kept) for r in minhash.near_duplicates(docs, width=2).collect()}
    assert got[3, TEXT + " indeed"] == (1, False) and got[2, TEXT] == (1, False) and got[1, TEXT] == (1, True)
    assert got[4, None] == (4, True) and got[5, ""] == (5, True) and got[None, "one"] == (None, True)
    assert minhash.near_duplicates(docs.filter("false")).count() == 0


def test_every_coordinate_of_a_sketch_fills_and_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 3, 400):
        assert (minhash.sketch(rng.integers(0, 2**63, n).astype(np.uint64)) != np.uint64(2**64 - 1)).all()
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    same = (minhash.sketch(a[:800], 2000) == minhash.sketch(a[100:], 2000)).mean()
    assert abs(same - 700 / 900) < 0.05


def test_common_counts():
    sets = [{bytes([i, j]) for i in range(40) if (i * k) % 3} for k in range(30) for j in (0, k % 2)]
    arrays = [np.unique(np.array([int.from_bytes(x) for x in s], np.uint64)) for s in sets]
    assert (minhash.common(arrays) == np.array([[len(a & b) for b in sets] for a in sets])).all()


def test_shards_are_gapless_and_grow_into_the_new_one(docs):
    got = sharding.external_shuffle(docs, n_shards=3).collect()
    assert len(got) == len(ROWS) and all(r.grown_shard in (r.shard, 3) for r in got)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.external_shuffle(docs.filter("false")).count() == 0


def test_mix_keeps_every_row_and_comes_near_targets(spark, docs):
    assert mixing.mix(docs, F.size(words(F.col("text")))).count() == len(ROWS)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), (F.col("id") % 97).alias("n"))
    got = mixing.mix(many, F.col("n")).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g"), F.max("copies").alias("m"))
    for r in got.collect():
        assert abs(r.t - r.g) < 100 and r.m <= 3


def test_pii_spans_and_text(docs):
    got = [r for r in pii.sanitise(docs).collect() if r.doc_id == 6]
    where = {(k, ROWS[6][1].index(x), ROWS[6][1].index(x) + len(x)) for k, x in (("email", "x.y@ex.am.org"), ("phone", "+44 20 7946 0958"))}
    assert len(got) == 2 and {(s.kind, s.start, s.end) for s in got[0].pii_spans if s.k < 4} == where
    assert "@" not in got[0].sanitised and "[PHONE]" in got[0].sanitised


def test_language_model_counts_every_row(docs):
    got = ngram_lm.score(docs).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (4, 5)} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert ngram_lm.score(docs.filter("false")).count() == 0


def _model(texts):
    """Counts of n-grams, and p(word after history) by brute force; histories are tuples of up to two words."""
    grams = {}
    for t in texts:
        seen = [" start", *t.lower().split(), " end"]
        for i in range(len(seen)):
            for k in range(min(i, 2) + 1):
                g = tuple(seen[i - k : i + 1])
                grams[g] = grams.get(g, 0) + 1
    own = [c for g, c in grams.items() if len(g) == 1 and g != (" start",)]

    def p(word, history):
        if not history:
            return (grams.get((word,), 0) + 1) / (sum(own) + len(own) + 1)
        return (grams.get((*history, word), 0) + 8 * p(word, history[1:])) / (grams.get(history, 0) + 8)

    return grams, p


def test_the_walk_agrees_with_brute_force_and_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "PIECE", 4)  # in this process; tasks keep theirs
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdEF"), rng.integers(0, 30))) for _ in range(60)] + ["a b c d e f " * 120]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_lm.score(docs, batch_bytes=100).collect()}
    grams, p = _model([t for i, t in enumerate(texts) if not got[i].held_out])
    wanted = []
    for i, t in enumerate(texts):
        seen = [" start", *t.lower().split(), " end"]
        wanted.append(sum(np.log10(p(seen[j], tuple(seen[max(0, j - 2) : j]))) for j in range(1, len(seen))))
        assert abs(got[i].score - wanted[i]) < 1e-9
    words = [g[0] for g in grams if len(g) == 1 and g != (" start",)] + ["never seen"]
    for history in [(), ("a",), ("a", "b"), (" start",), (" start", "c"), ("zz", "a")]:
        assert abs(sum(p(w, history) for w in words) - 1) < 1e-9
    g, held_out = ngram_lm.Grams(texts), np.array([got[i].held_out for i in range(len(texts))])
    one, two, three = g.trained(held_out)
    n, v = int(one.sum()), int((one > 0).sum())
    assert np.abs(ngram_lm.walk(g, (one, two, three), int((~held_out).sum()), n, v, 8.0) - wanted).max() < 1e-9 and held_out.any()


def test_packed_keys_come_back():
    for keys in ([5], [0, 1, 2**64 - 1], sorted(np.random.default_rng(0).integers(0, 2**63, 500).tolist())):
        keys = np.array(keys, np.uint64)
        assert (ngram_lm._unpacked(ngram_lm._packed(keys)) == keys).all()


def test_repeated_windows(spark):
    texts = ["a b c d a b c", "a a a a", "a b", None, "x " * 5]
    got = {r.doc_id: r for r in weak_supervision.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(j, j + 3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(covered))


def test_trees_learn_and_one_class_does_not_split():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    f = gbt_quality.fit(x[:400], y[:400])
    assert ((f.score(x[400:]) > 0.5) == y[400:]).mean() > 0.85
    assert np.ptp(gbt_quality.fit(x, np.ones(600)).score(x)) == 0
    assert len(gbt_quality.text_features(None)) == len(gbt_quality.FEATURES) == len(gbt_quality.text_features("A b"))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 8))
    v[7] = v[9] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 300, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == np.lexsort((np.arange(300), -s))[:5].tolist()


def test_calls_link_and_late_dependencies_are_ordered(spark):
    calls = [(1, "a", 1, "user", '{"turn": 1, "text": "x"}', ["b"]), (1, "b", 2, "user", '{"text":5}', []), (2, "c", 1, "none", "{", ["d"]), (2, "d", 2, "user", "[]", ["c"])]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, position long, tool string, arguments string, depends_on array<string>")
    r = spark.createDataFrame([(1, "a", 3, "yes"), (1, "z", 4, "?")], "conv_id long, call_id string, position long, content string")
    got = {x.call_id: x for x in chat_tools.link_tool_calls(c, r).collect()}
    assert got["a"].status == "linked" and got["a"].arguments_json == '{"text":"x","turn":1}' and got["a"].errors == []
    assert got["z"].status == "orphan" and (got["b"].topo_key, got["a"].topo_key, got["c"].topo_key, got["d"].topo_key) == ([2], [2, 1], None, None)
    assert got["b"].errors == ["type:text", "missing:turn"] and got["c"].errors == ["not_json"] and got["d"].errors == ["not_object"]


def test_repeated_identifiers_link_one_by_one_and_any_order_is_topological(spark):
    schema = "conv_id long, call_id string, position long, tool string, arguments string, depends_on array<string>"
    c = spark.createDataFrame([(1, "a", 1, "user", "{}", []), (1, "a", 2, "user", "{}", ["a", "gone"]), (1, None, 3, None, None, None), (None, None, 3, "user", "{}", [])], schema)
    r = spark.createDataFrame([(1, "a", 5, "x"), (1, None, 6, None), (1, None, 7, "y"), (None, None, None, None)], "conv_id long, call_id string, position long, content string")
    got = {(x.conv_id, x.call_id, x.repeat): (x.status, x.n_calls, x.n_results, x.result, x.missing, x.topo_key) for x in chat_tools.link_tool_calls(c, r).collect()}
    assert got == {
        (1, "a", 1): ("linked", 2, 1, "x", 0, [1]), (1, "a", 2): ("unanswered", 2, 0, None, 1, [2]), (1, None, 1): ("linked", 1, 2, None, 0, [3]), (1, None, 2): ("orphan", 0, 2, "y", None, None),
        (None, None, 1): ("linked", 1, 1, None, 0, [3]),
    }
    assert chat_tools.link_tool_calls(c.filter("false"), r.filter("false")).count() == 0
    rng = np.random.default_rng(4)
    order = rng.permutation(40).tolist()
    rows = [(1, f"c{x}", x, "user", "{}", [f"c{order[j]}" for j in rng.integers(0, i, min(i, 3))] if i else []) for i, x in enumerate(order)]
    got = {x.call_id: x for x in chat_tools.link_tool_calls(spark.createDataFrame(rows, schema), r.filter("false")).collect()}
    for _, name, _, _, _, needs in rows:
        assert all(got[n].topo_key < got[name].topo_key for n in needs)


def test_digests(spark):
    r = bpe.bpe_digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest() and r.n_tokens == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_of_learned_partitions(spark, monkeypatch, clustered):
    learned = []
    learn = ann.learn
    monkeypatch.setattr(ann, "learn", lambda v, parts, **kw: learned.append(parts) or learn(v, parts, **kw))
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1000, 16))
    if clustered:
        v = rng.standard_normal((20, 16))[rng.integers(0, 20, 1000)] + 0.3 * v
    got = ann.nearest(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    near = {q: set(np.argsort(-s[q])[:5].tolist()) for q in range(0, 1000, 5)}
    found = sum(r.vec_id in near[r.query_id] for r in got)
    print(f"recall@5 {found / 1000:.3f}, {learned[0]} partitions, clustered {clustered}")
    assert learned[0] >= 8 and len(got) == 1000 and found / 1000 >= 0.95


def test_a_query_is_routed_until_k_others_are_covered(spark, monkeypatch):
    v = np.random.default_rng(6).standard_normal((200, 4))
    monkeypatch.setattr(ann, "learn", lambda vectors, parts, **kw: (np.random.default_rng(0).standard_normal((5, parts)) * 40, 0.0))
    monkeypatch.setattr(ann, "PARTITION_ROWS", 16)
    got = ann.nearest(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>"), F.col("vec_id") < 40, k=50).collect()
    assert len(got) == 40 * 50


def _terms_found(spark, texts):
    found = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("size(pii_spans) > 0").collect()
    return {r.doc_id: {s.value: s.kind for s in r.pii_spans if s.k == 4} for r in found}


def test_a_term_of_one_document_is_weighed_with_or_without_copies(spark):
    texts = [f"please write to us at once about item number {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}" for i in range(1000)]
    texts[5] = "please write to Zbigniew at zb@ex.org about item"
    alone = _terms_found(spark, texts)
    assert alone[5] == {"zbigniew": "term_general"}
    copied = _terms_found(spark, [*texts, texts[5]])
    assert copied[5] == copied[1000] == alone[5]


def test_terms_are_found_in_the_whole_text_and_removed_from_every_text(spark):
    abc = "abcdefghij"
    texts = [f"item {abc[i % 10]}{abc[i // 10 % 10]}{abc[i // 100 % 10]}{abc[i // 1000]} in a list" for i in range(3000)]
    far = " item in a list" * 20
    for i in range(12):
        texts[i] = f"Li X7k9{far}\n{far} zb@ex.org{' a' * i}"
    texts[20] = "item li in a list without an address"
    found = _terms_found(spark, texts)
    assert all(found[i] == {"li": "term_removed", "x7k9": "term_removed"} for i in range(12))
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("doc_id = 20").collect()
    assert [(s.start, s.end, s.kind) for s in rows[0].pii_spans] == [(5, 7, "term_removed")] and rows[0].sanitised == "item  in a list without an address"


def test_partitions_of_partitions_keep_recall(spark):
    """16 partitions at most by a sample of 256: those of 6,000 vectors are cut again, and repeated text ids keep their order."""
    rng = np.random.default_rng(8)
    v = rng.standard_normal((40, 16))[rng.integers(0, 40, 6000)] + 0.5 * rng.standard_normal((6000, 16))
    rows = [(f"v{i:05d}", x, 1) for i, x in enumerate(v.tolist())]
    got = ann.nearest(spark.createDataFrame([*rows, rows[3]], "`v.id` string, `the.vector` array<double>, q int"), F.substring("`v.id`", 5, 2) == "00", "v.id", "the.vector", sample=256).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    found = 0
    for q in range(0, 6000, 100):
        s = u @ u[q]
        s[q] = -9
        near = {f"v{i:05d}" for i in np.argsort(-s)[:5]}
        mine = [r for r in got if r.query_id == f"v{q:05d}"]
        found += sum(r.vec_id in near for r in mine)
        assert sorted(r["rank"] for r in mine) == [1, 2, 3, 4, 5] and all(abs(r.score - s[int(r.vec_id[1:])]) < 1e-12 for r in mine)
    print(f"recall@5 {found / 300:.3f} over two levels")
    assert len(got) == 300 and found / 300 >= 0.9


def test_nearest_of_alike_vectors_and_of_empty_tables(spark, monkeypatch):
    """Vectors that no classifier can part stay in one partition and are scored in blocks."""
    monkeypatch.setattr(ann, "PARTITION_ROWS", 8)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    v = np.ones((300, 2)) + 1e-9 * np.arange(300)[:, None] * [1, -1]
    table = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "DEPTH", 2)
    got = ann.nearest(table, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 30 and all(r.score == pytest.approx(1) for r in got)
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0 and ann.nearest(table, F.lit(None).cast("boolean")).count() == 0
    assert ann.nearest(table.limit(1), F.lit(True)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 1.0]), (None, [1.0, 2.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(odd, F.lit(True)).orderBy("query_id").collect()] == [(4, 6), (6, 4)]
