"""Personal data, with DataFrame functions only.

Regular expressions propose spans; checksum validators confirm them (Luhn for cards,
mod-97 for IBANs, ranges and digit counts for addresses and phones); context words near a
span raise its score. The base kinds (email, ip, card, phone) stay whatever their score;
the kinds that the method adds (iban, ssn, secret) stay from ``THRESHOLD`` on.

Patterns are written for a backtracking engine: possessive groups iterate instead of
recursing (no stack overflow on runs of 100,000 digits), and a look-behind starts a
proposal only at the head of a run, which any match of these patterns must start at
unless the match before ended inside the run (``\\G``). Both keep time linear in the text
and change no result. An IBAN's end is not told by the characters after it, so each head (two
letters, two digits) proposes what follows up to the longest IBAN without taking it, and the
checksum is tried where a word of the proposal ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "ssn", "secret"]
KINDS = BASE_KINDS + ADDED_KINDS

# Proposals by kind.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])(?=([^0-9]{0,40}))",
    "secret": r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{20,}+)",
}
#: Characters of an IBAN by country; other countries' may have 15 to 34.
LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()
#: A text without this holds no match of the kind.
NEEDS = {"email": r"@[A-Za-z0-9]|@-", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-", "secret": r"[A-Za-z0-9_-]{20}"}
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
IP = rf"^{PART}(?:\.{PART}){{3}}$"

#: Score of a confirmed span by kind, and words that raise it by ``RAISE``
#: when they stand within ``NEAR`` characters before the span and after the match before it.
#: For ssn, also within as many after it, before the next digit; and what raised a match
#: raises those that are listed after it, with nothing but ``LISTED`` between.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|payment|amex", "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account|transfer", "ssn": "ssn|social|security", "secret": "token|secret|passw|(?:api|access|private)[ _-]?key|credential|bearer"}
RAISE, NEAR, THRESHOLD = 0.3, 40, 0.5
LISTED = r"^[^A-Za-z0-9]{0,10}(?:(?:and|or|und|oder|et|ou|y|o)\b[^A-Za-z0-9]{0,10})?$"

SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


#: Matches whose spans are gathered at once.
CHUNK = 256


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(iban: Column) -> Column:
    """Of the first four characters moved to the end, letters as 10 to 35."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97))


def _iban(proposed: Column) -> Column:
    """The longest beginning of a proposal, up to the end of one of its words, that has its
    country's length and the checksum; null if none has."""
    known = F.create_map(*(F.lit(x) for c in LENGTHS for x in (c[:2], int(c[2:]))))
    length = F.element_at(known, F.substring(proposed, 1, 2))
    words = F.split(proposed, " ")
    heads = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))

    def valid(head: Column) -> Column:
        n = F.length(F.replace(head, F.lit(" "), F.lit("")))
        return F.when(F.coalesce(n == length, n.between(15, 34)), _mod97(head) == 1).otherwise(False)

    return F.try_element_at(F.filter(heads, valid), F.lit(-1))


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(IP)
    if kind == "card":
        # the branch keeps runs of any length away from the checksum
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "secret":  # letters and digits, and no longer than keys are
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.length(match) <= 200)
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind, in order: kind, start and end in code points (end
    exclusive), score. Null text: no spans."""
    pattern = F.lit(PATTERNS[kind])
    matches, gaps = F.regexp_extract_all(text, pattern, 0), F.split(text, PATTERNS[kind], -1)
    # an IBAN's match is its head, the proposal is what the look-ahead saw
    # an SSN's group is what stands after it
    proposals = F.regexp_extract_all(text, pattern, 1) if kind in ADDED_KINDS else matches
    none = F.expr(f"cast(array() as {SPANS})")
    state = lambda at, raised, last, found: F.struct(at.alias("at"), raised.alias("raised"), last.alias("last"), found.alias("found"))
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, pair: Column) -> Column:
        gap, match = pair["gaps"], pair["matches"]
        begin = acc["at"] + F.length(gap)
        found = _iban(pair["proposals"]) if kind == "iban" else match
        end = begin + F.length(found)
        near = F.lower(F.right(gap, F.lit(NEAR)))
        raised = near.rlike(rf"\b(?:{CONTEXT[kind]})")
        if kind == "ssn":
            raised = raised | F.lower(pair["proposals"]).rlike(rf"\b(?:{CONTEXT[kind]})") | (acc["raised"] & gap.rlike(LISTED))
        score = F.lit(SCORES[kind]) + F.when(raised, F.lit(RAISE)).otherwise(F.lit(0.0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))
        if kind == "iban":  # none begins inside another
            keep = found.isNotNull() & (begin >= acc["last"])
        else:
            keep = _confirmed(kind, match)
        if kind not in BASE_KINDS:
            keep = keep & (score >= THRESHOLD)
        return state(begin + F.length(match), raised, F.when(keep, span["end"]).otherwise(acc["last"]), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]))

    def together(acc: Column, chunk: Column) -> Column:
        """A chunk's spans: appending to one long array would copy it for each span."""
        made = F.aggregate(chunk, state(acc["at"], acc["raised"], acc["last"], none), step)
        return state(made["at"], made["raised"], made["last"], F.concat(acc["found"], F.array(made["found"])))

    pairs = F.filter(F.arrays_zip(gaps.alias("gaps"), matches.alias("matches"), proposals.alias("proposals")), lambda p: p["matches"].isNotNull())
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)))
    chunks = F.when(F.size(pairs) > 0, chunks).otherwise(F.array(pairs))
    empty = state(zero, F.lit(False), zero, F.expr(f"cast(array() as array<{SPANS}>)"))
    found = F.flatten(F.aggregate(chunks, empty, together, lambda acc: acc["found"]))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(none)


def find(df: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """``df`` with an array column ``to`` of all spans by kind as listed in ``KINDS``, then
    start. Null text: an empty array. A column named as ``to`` is replaced."""
    kept = df.drop(to)
    value = F.coalesce(F.col(text), F.lit(""))
    columns = {f"_{to}_{kind}": spans_of(value, kind) for kind in KINDS}
    return kept.withColumns(columns).withColumn(to, F.concat(*(F.col(c) for c in columns))).drop(*columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds by document, a digest of the base spans, and all spans, for
    every row: null text has none, and repeated rows are digested each."""
    found = find(docs.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(F.col("doc_id").cast("long"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """``text`` with each span replaced by its kind in brackets, such as ``[email]``.
    Overlapping spans are replaced together, by the kind of the one that starts first
    (the longer of two with one start). Null text stays null."""
    order = F.array_sort(F.col(spans), lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))
    piece = "array<string>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as {piece})").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(fresh).alias("out"))

    merged = F.aggregate(order, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
    return df.withColumn(text, F.when(F.size(spans) > 0, merged).otherwise(F.col(text)))
