"""Language-model scores, language identification, mixing and top-k search."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import langid, lm, mixing, topk
from tests.llm.util import empty, odd, odd_rows


def words(text):
    return (text or "").encode().lower().split()


def brute_scores(texts: list[str | None], order: int) -> list[tuple[int, int]]:
    """n_words and log_score of each text against all the others."""
    log = lambda f: round(math.log(f) * 1e6)
    listed = [words(t) for t in texts]
    own = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in listed]
    every, total, out = Counter(), sum(map(len, listed)), []
    for c in own:
        every.update(c)
    for w, mine in zip(listed, own, strict=True):
        f, s = lambda *g: every[g] - mine[g], 0  # noqa: B023
        for i in range(len(w)):
            longest = min(order, i + 1)
            k = next((k for k in range(longest, 1, -1) if f(*w[i - k + 1 : i + 1]) > 0), 1)
            s += log(f(*w[i - k + 1 : i + 1])) - log(f(*w[i - k + 1 : i])) if k > 1 else log(max(1, f(w[i]))) - log(max(1, total - len(w)))
            s += (longest - k) * log(0.4)
        out.append((len(w), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = odd_rows()
    want = [(r[0], *x) for r, x in zip(rows, brute_scores([r[1] for r in rows], order), strict=True)]
    got = lm.score_corpus(odd(spark), order).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["log_score"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["mean_log"] == (math.floor(r["log_score"] / r["n_words"]) if r["n_words"] else None) for r in got)


def test_backing_off_after_a_shuffle(spark):
    """Rows that reach the operator through a shuffle, in many stretches' buckets; a very long
    text and words that are seen in one row only."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef") + rng.choice(["", "", str(rng.randint(0, 300))]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["lone", "a b c lone", " ".join(rng.choice("abcdef") for _ in range(150_000)), texts[3], texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7).dropDuplicates(["doc_id"])
    got = sorted((r["doc_id"], r["n_words"], r["log_score"]) for r in lm.score_corpus(docs).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_scores(texts, 3))]


def test_stretches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 500)  # read on the driver
    texts = [f"the cat {i % 3} sat on {i % 5} mats" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    got = sorted((r["doc_id"], r["n_words"], r["log_score"]) for r in lm.score_corpus(docs).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_scores(texts, 3))]


def test_new_documents_back_off(spark):
    corpus = spark.createDataFrame([("a b a b c",)], "text string")
    table = lm.count_tables(corpus, 2)
    got = {r["doc_id"]: r["log_score"] for r in lm.score_new(spark.createDataFrame([(1, "a b"), (2, "c a"), (3, "zzz"), (4, None)], "doc_id long, text string"), table, 2).collect()}
    assert got[1] == pytest.approx(math.log(2 / 5) + math.log(2 / 2))
    assert got[2] == pytest.approx(math.log(1 / 5) + math.log(0.4) + math.log(2 / 5))
    assert got[3] == pytest.approx(math.log(1 / 5)) and got[4] == 0


def test_the_registered_query_equals_its_oracle(spark):
    import os

    import duckdb

    from quillon.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = [tuple(r) for r in queries.op5_lm_scoring(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(queries.OP5).fetchall(), key=repr)


def test_empty_corpus(spark):
    assert lm.score_corpus(empty(spark)).count() == 0


# --- language identification ------------------------------------------------------------

SYLLABLES = {"x1": ["the", "ing", "and", "tion"], "x2": ["der", "sch", "ung", "ich"], "x3": ["que", "ción", "los", "mente"]}


def corpus(n: int = 600):
    rng = random.Random(9)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 40))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=80)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).withColumn("held", langid.held_out(F.col("doc_id"))).collect()}
    assert all(got[i]["held"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(i, lang) for i, _, lang in rows if got[i]["held"]]
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    again = langid.fit(docs.repartition(3), per_language=80)
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature
    assert (model.weights == 0).mean() > 0.3  # sparse


def test_very_long_texts_are_read_piece_by_piece(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé Ωx1\n") for _ in range(n)) for n in (0, 1, 2, 3, 700, langid.CHUNK - 1, langid.CHUNK, langid.CHUNK + 1, 3 * langid.CHUNK + 5)]
    for text, (index, counts) in zip(texts, langid.counts_of(texts), strict=True):
        whole = sum((np.bincount(f, minlength=langid.FEATURES) for f in langid.gram_numbers(text.lower()) if len(f)), np.zeros(langid.FEATURES, int))
        assert np.array_equal(np.flatnonzero(whole), index) and np.array_equal(whole[index], counts)
    rows = corpus(300)
    docs = spark.createDataFrame(rows + [(10**6, " ".join(t for _, t, lang in rows if lang == "x2") * 60, "x2")], "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).filter("doc_id = 1000000").first()
    assert got["lang_pred"] == "x2"


def test_without_letters_or_labels(spark):
    docs = odd(spark)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(odd_rows())
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in got)
    assert langid.fit(empty(spark)) is None and langid.identify(empty(spark), None).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


# --- mixing -----------------------------------------------------------------------------


@pytest.mark.parametrize("total", [80_000_000, 5_000_000_000])
def test_small_sources_come_near_their_targets(total):
    sizes = [total // 3] + [total * 2 // 57] * 19 + [300, 500, 700, 1500, 2000, 7]
    goals = mixing.targets(sizes, weights := [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
    sources = [mixing.Source(str(i), z, w, g) for i, (z, w, g) in enumerate(zip(sizes, weights, goals, strict=True))]
    plan = mixing.quotas(sources, {(i, 0): z for i, z in enumerate(sizes)}, mixing.block_of(sources), 7)
    for i, _, passes, a, b, c in plan:
        assert abs(passes * sizes[i] + b - a + c - goals[i]) <= max(1, 0.02 * goals[i]), (i, sizes[i], goals[i])


def test_a_small_source_keeps_its_documents(spark):
    rows = [(i, "w " * 30_000, "ab"[i % 2]) for i in range(40)] + [(100 + i, "w " * 10, "c") for i in range(10)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source = 'c'").collect()
    assert sum(r["taken"] for r in got) == pytest.approx(300, rel=0.02) and all(r["copies"] == 3 for r in got)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    goals = mixing.targets(sizes, weights)
    assert sum(goals) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-6 for g, s in zip(goals, sizes, strict=True))
    free = [g / w for g, s, w in zip(goals, sizes, weights, strict=True) if g < 3 * s - 1e-6]
    assert not free or max(free) == pytest.approx(min(free))


@given(st.lists(st.integers(0, 100), min_size=1, max_size=8), st.integers(0, 60))
@settings(deadline=None)
def test_highest_quotients(votes, seats):
    got = mixing.sainte_lague(list(map(float, votes)), seats)
    plain = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
        plain[i] += 1
    assert sum(got) == sum(plain)
    # equal quotients may go either way
    assert sorted(v / (2 * g + 1) for v, g in zip(votes, got, strict=True)) == pytest.approx(sorted(v / (2 * g + 1) for v, g in zip(votes, plain, strict=True)))


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 90))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    size = {i: len(t.encode().split()) for i, t, _ in rows}
    assert all(r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows)
    taken, goal, of = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        of[r["source"]] += r["size"]
    names = sorted(of, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([of[s] for s in names], [5, 2, 1, 5][: len(names)]), strict=True))
    for s in names:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 3
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect())) == sorted(map(tuple, got))


def test_mix_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in odd_rows())
    assert mixing.mix(empty(spark)).count() == 0


# --- top-k search -----------------------------------------------------------------------


def brute_top(ids, vectors, queries, k):
    out = []
    for q in queries:
        i = ids.index(q)
        scores = sorted((-sum(a * b for a, b in zip(vectors[i], v, strict=True)), j) for j, v in zip(ids, vectors, strict=True) if j != q)
        out += [(q, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "few"])
def test_search_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    n = 3 if kind == "few" else 300
    x = rng.normal(size=(n, 6)) if kind != "equal" else np.tile(rng.normal(size=(1, 6)), (n, 1))
    if kind == "clustered":
        x = rng.normal(size=(5, 6))[rng.integers(0, 5, n)] * 4 + x * 0.05
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 7 == 0, data_block=60, query_block=15, leaf=4).collect()
    ints = [[math.floor(256 * float(c)) for c in v] for v in x]
    assert sorted(map(tuple, got)) == brute_top(list(range(n)), ints, range(0, n, 7), 5)


def test_cover_tree_covers():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(500, 3)) * 100)

    def members(node):
        return node.members.tolist() if node.members is not None else [m for c in node.children for m in members(c)]

    def check(node):
        far = np.sqrt(((x[members(node)] - node.centre) ** 2).sum(axis=1)).max()
        assert far <= node.radius + 1e-9
        for c in node.children:
            check(c)

    tree = topk.cover_tree(x)
    assert sorted(members(tree)) == list(range(500)) and tree.children
    check(tree)


@pytest.mark.parametrize(("spread", "most"), [(0.02, 0.4), (10.0, 1.0)])
def test_share_of_pairs_scored(spread, most):
    """Clustered vectors are pruned; those that lie everywhere aren't, and none is missed."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(8, 64))[rng.integers(0, 8, 3000)] + spread * rng.normal(size=(3000, 64))))
    ids, seen = np.arange(3000), []
    got = topk.search(x[::50], ids[::50], x, ids, 5, seen=seen)
    scores = x[::50] @ x.T
    scores[np.arange(60), ids[::50]] = -np.inf
    want = np.sort(scores, axis=1)[:, -5:].sum()
    assert sum(s for _, _, s in got) == want and sum(seen) <= most * 60 * 3000


def test_unusable_and_huge_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, [2.0, 2.0]), (None, [1.0, 1.0]), (7, [1e9, 1e9]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(df, F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7, 256 * 256 * 3 * 10**9), (0, 2, 6, 6 * 65536), (0, 3, 8, -65536), (0, 4, 8, -65536)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
