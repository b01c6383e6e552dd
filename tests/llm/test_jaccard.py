from __future__ import annotations

import random

import numpy as np
import pytest

from quillon.llm import jaccard
from tests.llm.util import empty, odd, odd_rows


def shingles(text: str | None, width: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple], width: int, percent: int) -> list[tuple]:
    sets = [shingles(t, width) for _, t in rows]
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                of[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(rng: random.Random, words: list[str], edits: int) -> str:
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("width", "percent", "small"), [(3, 90, 4096), (5, 80, 4096), (3, 80, 4)])
def test_equals_brute_force(spark, monkeypatch, width, percent, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PACKED", 3)
    monkeypatch.setattr(jaccard, "HOT", 3 if small < 4096 else 20)
    rng = random.Random(width * percent + small)
    texts = []
    for n in (4, 12, 30, 60, 150, 400):
        base = [f"w{rng.randrange(300)}" for _ in range(n)]
        for _ in range(40):
            texts.append(edited(rng, base, rng.randrange(0, 2 + n // 12)))
        # a chain: each differs a little from the one before
        step = base
        for _ in range(8):
            step = edited(rng, step, max(1, n // 60)).split()
            texts.append(" ".join(step))
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width, percent)


def test_bands_cover_every_linked_pair():
    for percent in (80, 90, 95):
        bands = jaccard.Bands(percent, 10**6)
        for n in [*range(1, 400), 1000, 99999]:
            for m in range(-(-n * percent // 100), n + 1):
                band = max(bands.of(m))
                assert band in bands.of(n)
                words, spare = bands.words(band)
                assert words == 1 and bands.difference(m) == 0 or words - bands.difference(m) >= spare + 1


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    got = jaccard.jaccard_components(odd(spark), 3, 90).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((t if t[1] else (t[0], 0, t[0]) for t in brute(rows, 3, 90)), key=repr)
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_the_registered_query_equals_its_oracle(spark):
    import os

    import duckdb

    from quillon.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = [tuple(r) for r in queries.op8_ngram_jaccard_join(spark, sf).collect()]
    assert sorted(got) == sorted(con.execute(queries.OP8).fetchall())


def test_very_long_texts(spark):
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 10**7)}" for _ in range(250_000)]
    near = list(words)
    near[1000:1010] = ["other"] * 10
    rows = [(3, " ".join(words)), (2, " ".join(near)), (1, " ".join(words[:200_000])), (4, "short text here")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {3: 2, 2: 2, 1: 1, 4: 4}


def test_wide_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(5)
    assert jaccard.wide_sketch(rng.integers(0, 1 << 64, 512, np.uint64)) is None
    for n, m in ((513, 600), (1000, 1100), (1024, 1025), (2049, 1900), (5000, 4000), (3000, 3000)):
        for common in (0, min(n, m) // 2, min(n, m) - 20, min(n, m)):
            members = rng.integers(0, 1 << 64, n + m - common, np.uint64)
            a, b = members[:n], members[n - common :]
            apart = jaccard.bits_apart(jaccard.wide_sketch(a), jaccard.wide_sketch(b))
            assert apart <= n + m - 2 * common
            assert common or apart * 80 > min(n, m) * 20  # sets that share nothing don't pass


def test_long_texts_equal_brute_force(spark):
    rng = random.Random(31)
    texts = []
    for n in (560, 1020, 1060, 2100):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        texts += [edited(rng, base, rng.randrange(0, n // 18)) for _ in range(14)]
        texts += [edited(rng, base[: n - n // 12], rng.randrange(0, n // 60)) for _ in range(8)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    for width, percent in ((5, 80), (3, 90)):
        want = brute(rows, width, percent)
        assert 4 < len({c for _, _, c in want}) < len(rows)
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_long_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(150)
    rows = [(i, " ".join(fresh(700) + passage + fresh(700))) for i in range(60)]
    rows.append((60, edited(rng, rows[7][1].split(), 5)))
    read, texts_of = [], jaccard.Join.texts_of

    def seen(self, nids):
        read.append(nids.count())
        return texts_of(self, nids)

    monkeypatch.setattr(jaccard.Join, "texts_of", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {i: 7 if i == 60 else i for i in range(61)}
    assert sum(read) == 2, read  # the texts of the linked pair, once


def test_many_pairs_are_verified_in_rounds(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    rows = [(i, edited(rng, base, rng.randrange(1, 3))) for i in range(60)]
    made, materialise = [], jaccard.materialise

    def seen(df, name):
        made.append(name)
        return materialise(df, name)

    monkeypatch.setattr(jaccard, "ONCE", 0)
    monkeypatch.setattr(jaccard, "materialise", seen)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 3, 80)
    assert made.count("linked") > 1
