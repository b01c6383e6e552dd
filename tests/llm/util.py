"""Tables that hold every odd case, for all operators."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tid string, nid string, key string, size string, rank string, length string, salt string, pii string, media string, spans string, n string, shard string, title string"
BASE = " ".join(f"word{i} and the other{i % 7}" for i in range(120))
TEXTS = [
    None, "", " ", "\n\t", "12345 6789", "one", "two words", "a b c d e f g", BASE, BASE, BASE + " tail", BASE.upper(), "é" * 700, "x" * 3000, "ab " * 2000,
    "mail me@example.org or 4111 1111 1111 1111 from 10.0.0.1 call +1 (555) 010-9999", "+" * 50 + "9" * 500, "…😀▁ \x00<|endoftext|>", BASE + BASE, "1.2.3.4.5.6.7.8 a@b.c_x@d.e 0000-0000 0000 0000",
]


def odd_rows() -> list[tuple]:
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "c"][i % 4], None, *["x"] * 12) for i, t in enumerate(TEXTS)]
    return rows + [rows[8], rows[8], (None, None, None, None, None, *[None] * 12), (None, BASE, "en", "a", 3, *["y"] * 12), (5, "another text with five words", "fr", "b", 1, *["z"] * 12)]


def odd(spark):
    return spark.createDataFrame([r[:17] for r in odd_rows()], SCHEMA.rsplit(",", 1)[0])


def empty(spark):
    return odd(spark).limit(0)
