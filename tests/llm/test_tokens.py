from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import tokens
from tests.llm.util import TEXTS, empty, odd, odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab eE \n\t▁é😀中12<>s/", max_size=120))
def test_equals_the_library(text):
    assert tokens.counter(PATH).count(text) == len(LIBRARY.encode(text))


def test_long_texts_and_eviction(monkeypatch):
    monkeypatch.setattr(tokens.Counter, "FULL", 50)
    counter = tokens.Counter(tokens.Pieces.load(PATH))
    for text in (t for t in TEXTS if t):
        assert counter.count(text) == len(LIBRARY.encode(text))
    assert len(counter) < 2000


def test_refuses_pieces_that_join_words():
    with pytest.raises(ValueError):
        tokens.Pieces({"a▁b": 0})


def test_column(spark):
    found = tokens.count_tokens(odd(spark), PATH).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(LIBRARY.encode(r[1] or "")), n > 4096) for r in odd_rows()]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert tokens.count_tokens(empty(spark), PATH).count() == 0
