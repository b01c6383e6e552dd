from __future__ import annotations

import hashlib
import re


from quillon.llm import pii
from tests.llm.util import empty, odd, odd_rows

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_random_texts_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab.@_-+ 0123456789()é😀\n") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(rng.choice(["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 555 010 9999", "1.2.3.4", "256.1.1.1", "007.08.9.255", "x@y.z", "a.b+c@d-e.f.g", " ", ".", "@", "-", "_", "9"]) for _ in range(8)) for _ in range(1500)]
    rows = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = base(text)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), text
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(k == x for x, _, _ in want) for k in PATTERNS]
        assert rows[i]["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))


def test_texts_with_many_spans(spark):
    """More than are gathered at once, of each kind, in one text."""
    text = "; ".join(f"a{i}@b{i}.org 10.{i % 300}.0.{i % 256} 4111 1111 1111 1111, +1 555 01{i % 10} 99{i % 100:02}" for i in range(1100))
    ibans = " and ".join(["GB82 WEST 1234 5698 7654 32"] * 700)
    rows = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame([(1, text), (2, ibans)], "doc_id long, text string")).collect()}
    want = base(text)
    assert rows[1]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest() and len(want) > 3000
    assert rows[2]["spans"].count("iban:") == 700


def test_runs_of_digits_and_letters_stay_linear(spark):
    texts = ["9" * 200_000, "a" * 200_000, "1." * 100_000, "+" * 100_000 + "1", "4111 " * 40_000]
    rows = pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 5


def test_added_kinds(spark):
    text = "bank account GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33; ssn 123-45-6789, part 123-45-6789"
    (row,) = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    at = text.index("123-45")
    assert [s for s in row["spans"].split(",") if s[:4] in ("iban", "ssn:")] == [f"iban:{text.index('GB82')}:{text.index('GB82') + 27}", f"ssn:{at}:{at + 11}"]


def test_secrets_need_a_context(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = {f'and token = "{key}"### more': 1, f"password: {key}": 1, f"revision {key} of the file": 0, "token abcdefghijklmnopqrstuvwxyz": 0, "token 1234": 0, "api_key=AKIA" + "A1" * 10: 1, "secret " + "a1" * 5000: 0, f"é😀 bearer {key}": 1}
    rows = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (text, n) in enumerate(texts.items()):
        found = [tuple(map(int, x.split(":")[1:])) for x in rows[i]["spans"].split(",") if x.startswith("secret")]
        assert len(found) == n and rows[i]["n_spans"] == len([x for x in rows[i]["spans"].split(",") if x]), text
        assert all(text[a:b] in (key, "AKIA" + "A1" * 10) for a, b in found)


def test_ibans_before_capitals_and_digits(spark):
    de, gb, no, be = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "BE68539007547034"
    texts = {f"IBAN {de} The": [de], f"IBAN {gb} Please pay": [gb], f"{de} BIC COBADEFFXXX": [de], f"{de} 12 euros": [de], f"{no} {be} X": [no, be], f"{de} {gb} {no} 1 A": [de, gb, no], f"é😀 {gb}\nB2": [gb], f"x{de} A": [], f"{de}A B": [], f"{de[:-1]}1 The": [], "AB12 " * 20_000: []}
    rows = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (text, want) in enumerate(texts.items()):
        got = [tuple(map(int, x.split(":")[1:])) for x in rows[i].split(",") if x.startswith("iban")]
        assert [text[a:b] for a, b in got] == want, text[:60]


def test_listed_numbers_and_context_after(spark):
    texts = {"SSNs: 123-45-6789, 234-56-7890 and 345-67-8901": 3, "123-45-6789 (SSN)": 1, "parts 123-45-6789, 234-56-7890": 0, "ssn 123-45-6789, part 234-56-7890": 1}
    rows = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].count("ssn:") for i in range(len(texts))] == list(texts.values())


def test_redaction(spark):
    text = "é😀 write me@example.org, call +1 555 010 9999 or 10.0.0.1"
    found = pii.redact(pii.find(spark.createDataFrame([(1, text), (2, None), (3, "clean")], "doc_id long, text string")))
    assert [r["text"] for r in found.orderBy("doc_id").collect()] == ["é😀 write [email], call [phone] or [ip]", None, "clean"]


def test_odd_rows(spark):
    rows = pii.digest(odd(spark)).collect()
    want = sorted((repr(r[0]), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(r[1] or "")).encode()).hexdigest()) for r in odd_rows())
    assert sorted((repr(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    assert pii.digest(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.digest(odd(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])
