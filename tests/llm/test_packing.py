from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import packing
from tests.llm.util import empty, odd, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(plan: packing.Plan, counts: dict[int, int], capacity: int) -> None:
    placed, used = Counter(), defaultdict(list)
    for length, first, n, sequence, each, offset in plan.rows:
        assert first == placed[length]
        placed[length] += n
        for i in range(n):
            used[sequence + i // each].append((offset + i % each * length, length))
    assert placed == Counter(counts) and set(used) == set(range(plan.sequences))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), min_size=1, max_size=40))
def test_plans_are_gapless(counts):
    plan = packing.make_plan(counts, 100)
    check(plan, counts, 100)
    assert plan.sequences <= 2 * -(-sum(x * n for x, n in counts.items()) // 100)


def test_close_to_the_bound():
    rng = random.Random(5)
    counts = Counter(min(4096, int(rng.lognormvariate(6.2, 1.1)) + 1) for _ in range(20_000))
    plan = packing.make_plan(dict(counts))
    check(plan, counts, 4096)
    assert plan.sequences <= 1.002 * sum(x * n for x, n in counts.items()) / 4096 + 1


def test_configurations_are_optimal():
    columns, uses = packing.best_configurations(np.array([60, 40, 30]), np.array([10, 10, 8]), 100)
    assert uses.sum() == pytest.approx(10 + 8 * 30 / 90) and (np.array([60, 40, 30]) @ columns <= 100).all()


def test_plan_size_is_bounded():
    counts = {x: 10**9 + x for x in range(1, 4097)}
    plan = packing.make_plan(counts, 4096, ((24, 3),))
    assert len(plan.rows) < 40_000


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("aB eE'st \n\téßIıİΣς12.,!<|endoftext|>́İ", max_size=80))
def test_word_cache_equals_the_library(text):
    assert packing.word_ids(PATH).encode(text) == np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pack(spark):
    capacity = 64
    rows = packing.pack(odd(spark), PATH, capacity).collect()
    want = Counter()
    for r in odd_rows():
        ids = [*LIBRARY.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want[r[0], piece, at, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    ends = defaultdict(list)
    for r in rows:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in ends.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= capacity
    assert packing.pack(empty(spark), PATH).count() == 0
