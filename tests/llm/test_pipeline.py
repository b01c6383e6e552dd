from __future__ import annotations

from collections import Counter

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from quillon.llm import langid, mixing
from tests.llm.test_jaccard import brute
from tests.llm.test_pii import base
from tests.llm.util import empty, odd, odd_rows

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == p.COLUMNS, name
        out.collect()
        assert stage(spark, empty(spark), "").count() == 0
    assert p.pack_sequences(spark, docs, "").count() >= len(odd_rows())


def test_near_duplicates_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w77 ", "other ")
    rows = [(1, base, "en", "a", 1), (2, near, "en", "a", 1), (3, base, "en", "b", 1), (4, "quite another text of several words", "en", "a", 1), (5, "", "en", "a", 1), (6, None, None, None, None)]
    kept = p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4, 5, 6]


def test_near_duplicates_go_whatever_their_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    near = lambda t, n: t.replace(f"{n}77 ", "other ")
    rows = [(None, a), (None, near(a, "a")), (1, b), (None, near(b, "b")), (2, c), (3, near(c, "c")), (3, "quite another text of several words"), (3, "quite another text of several words")]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, docs, "").collect()), key=repr)
    assert len(kept) == 4 and sum(i is None for i, _ in kept) == 1 and [x for x in kept if x[0] is not None] == [(1, b), (2, c), (3, "quite another text of several words")]


def test_personal_data_goes(spark):
    rows = [(1, "call +1 555 010 9999 now", "en", "a", 24), (2, None, None, None, None)]
    got = p.personal_data(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got) == [(1, "call [phone] now", 16), (2, None, None)]


def test_mix_takes_whole_documents(spark):
    rows = [(i, f"some words of text number {i}", "en", "ab"[i % 10 == 0], 9) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(r["source"] for r in p.mix_sources(spark, docs, "").collect())
    assert 100 <= got["a"] <= 170 and 40 <= got["b"] <= 75


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return Counter(tuple(r) for r in df.select(p.COLUMNS).collect())


def test_language_stage_keeps_what_is_sure(spark, docs):
    kept = rows_of(p.language_id(spark, docs, SF))
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert kept == Counter(tuple(r[c] for c in p.COLUMNS) for r in found if r["lang_pred"] != "und" and r["score"] >= p.LEAST_SCORE)
    assert sum(kept.values()) >= 0.95 * docs.count()


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    component = {d: c for d, _, c in brute(rows, p.SHINGLE, p.PERCENT)}
    worded = {d for d, t in rows if (t or "").split()}
    want = {d for d, _ in rows if d not in worded or component[d] == d}
    got = p.near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want) and {(r["doc_id"], r["text"]) for r in got} <= set(rows)


def test_personal_data_equals_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in p.personal_data(spark, docs, SF).collect():
        found = base(texts[r["doc_id"]] or "")
        if not found:
            continue
        gone = {texts[r["doc_id"]][a:b] for _, a, b in found}
        assert not any(kind == "email" and texts[r["doc_id"]][a:b] in r["text"] for kind, a, b in found), gone
        assert r["n_chars"] == len(r["text"]) and sum(r["text"].count(f"[{k}]") for k in ("email", "ip", "card", "phone", "iban", "ssn", "secret")) > 0


def test_mixing_comes_near_every_target(spark, docs):
    size, taken = Counter(), Counter()
    words = lambda t: len((t or "").encode().split())
    longest = Counter()
    for r in docs.collect():
        size[r["source"]] += words(r["text"])
        longest[r["source"]] = max(longest[r["source"]], words(r["text"]))
    for r in p.mix_sources(spark, docs, SF).collect():
        taken[r["source"]] += words(r["text"])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goals = dict(zip(names, mixing.targets([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    assert all(abs(taken[s] - goals[s]) <= 0.02 * goals[s] + longest[s] for s in names)


def test_the_whole_run_packs_what_the_stages_keep(spark, docs):
    kept = docs
    for _, stage in p.STAGES[:-1]:
        kept = p.materialise(stage(spark, kept, SF), "test")
    pieces = p.run(spark, SF)
    assert Counter(r["doc_id"] for r in pieces.filter("piece = 0").collect()) == Counter(r["doc_id"] for r in kept.collect())
    placed = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces")).collect()
    assert all(r["n"] == r["end"] <= 4096 and r["places"] == r["pieces"] for r in placed)


@pytest.mark.parametrize(("stage", "others"), [("pii", 0), ("best_fit_packing", 1)])
def test_stages_begin_with_small_heaps(spark, stage, others):
    # the driver is the only executor here, and itself collects once for each table it writes
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = odd(spark)
    before = full()
    dict(p.STAGES)[stage](spark, docs, "")
    assert full() - before > others
