from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import suffixes
from tests.llm.util import empty, odd, odd_rows


def brute(texts: list[str], window: int) -> list[tuple[int, int, int, str]]:
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_passages(texts: list[str], passage: int) -> list[tuple[int, int]]:
    listed = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    seen = Counter(tuple(w[i : i + passage]) for w in listed for i in range(len(w) - passage + 1))
    out = []
    for w in listed:
        inside = np.zeros(len(w), bool)
        for i in range(len(w) - passage + 1):
            if seen[tuple(w[i : i + passage])] > 1:
                inside[i : i + passage] = True
        out.append((int(inside.sum()), int((np.diff(np.r_[0, inside.astype(int)]) == 1).sum())))
    return out


def run(spark, texts, window, **more):
    rows = suffixes.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window, **more).orderBy("doc_id").collect()
    if passage := more.get("passage", 51):
        assert [(r["n_passage_words"], r["n_passages"]) for r in rows] == brute_passages(texts, passage)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in rows)
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows]


def passages(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 120))) for _ in range(8)]
    return ["".join(rng.choice(pool)[: rng.randint(5, 120)] if rng.random() < 0.6 else "".join(rng.choice("wxyz") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = passages(seed, 250) + ["ab" * 200, "a" * 90, "b" * 47, "b" * 48, "b" * 49, "", "ab" * 30]
    assert run(spark, texts, 48) == brute(texts, 48)


@pytest.mark.parametrize("cut", [0, 12])
def test_anchors_with_many_contexts(spark, cut):
    """One passage in many documents: parts are dealt again, and windows of large parts are
    counted."""
    rng = random.Random(4)
    passage = "".join(rng.choice("pqrst") for _ in range(70))
    texts = ["".join(rng.choice("ab") for _ in range(60)) + passage[rng.randint(0, cut) : 70 - rng.randint(0, cut)] + "".join(rng.choice("cd") for _ in range(60)) for _ in range(120)]
    assert run(spark, texts, 48, many=3, passage=0) == brute(texts, 48)
    assert run(spark, texts, 48, many=60, passage=0) == brute(texts, 48)


@pytest.mark.parametrize("many", [4, 4096])
def test_passages_of_words(spark, many):
    rng = random.Random(many)
    pool = [[rng.choice(["a", "B", "é", "word"]) + str(rng.randint(0, 9)) for _ in range(30)] for _ in range(3)]
    texts = []
    for _ in range(120):
        w = [f"x{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, 30))]
        p = rng.choice(pool)
        w[len(w) // 2 : len(w) // 2] = p[rng.randint(0, 8) : 30 - rng.randint(0, 8)]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += ["", "A" * 30, "a b c " * 10, texts[3].upper(), texts[5]]
    assert run(spark, texts, 48, passage=12, many=many) == brute(texts, 48)


def test_very_long_text(spark):
    rng = random.Random(6)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(200_000))
    texts = [long, "x" + long[1000:2000] + "y", long[-450:]]
    assert run(spark, texts, 400, passage=51) == brute(texts, 400)


def test_construction_by_columns():
    rng = np.random.default_rng(1)
    columns = rng.integers(0, 2, (60, 20)).astype(np.int16)
    columns[5, :4] = 256
    group = rng.integers(0, 4, 60)
    starts = suffixes.repeated_starts(columns, group, 6, 256)
    for i in range(60):
        for j in range(15):
            piece = columns[i, j : j + 6]
            want = bool((piece != 256).all()) and any(group[k] == group[i] and k != i and (columns[k, j : j + 6] == piece).all() for k in range(60))
            assert starts[i, j] == want


def test_odd_rows(spark):
    texts = [r[1] or "" for r in odd_rows()]
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(odd(spark)).collect())
    assert got == sorted(brute(texts, 400))
    assert suffixes.dedup(empty(spark)).count() == 0
