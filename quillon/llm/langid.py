"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained with follow-the-regularised-leader (proximal, elastic net) and calibrated
by a temperature.

Document frequencies cover every labelled document that may be learned from; the weights
are fitted on a bounded sample of them (``per_language`` rows each, by a hash of the row).
A text's features are counts of its hashed 1- to 3-grams of characters, lower-cased, with
ASCII other than letters as one separator character.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cache_of, mix64, short_batches, slices

#: Hashed features, and rows of each language that the weights are fitted on.
FEATURES, PER_LANGUAGE = 1 << 14, 600
#: Of the follow-the-regularised-leader updates, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 4
UNKNOWN = "und"
SEPARATOR = 32
#: Characters whose features are found at once (about 60 bytes for each), and bytes of text
#: that become Python strings at once.
CHUNK, SLICE = 1 << 18, 1 << 20
#: ASCII letters stay, all other ASCII is a separator.
ASCII = np.array([c if chr(c).isalpha() else SEPARATOR for c in range(128)], np.uint32)
LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(LETTER.search(text) or any(map(str.isalpha, text)))


def gram_numbers(text: str) -> list[np.ndarray]:
    """By order, the feature of the n-gram that starts at each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ascii_ = points < 128
    points[ascii_] = ASCII[points[ascii_]]
    one = points.astype(np.uint64) + np.uint64(1)
    two = one[:-1] | one[1:] << np.uint64(21) if len(one) > 1 else one[:0]
    three = two[:-1] | one[2:] << np.uint64(42) if len(one) > 2 else one[:0]
    return [(mix64(grams) & np.uint64(FEATURES - 1)).astype(np.int32) for grams in (one, two, three)]


def counts_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and counts of each text. About ``CHUNK`` characters are worked on at
    once: short texts together, a longer text piece by piece."""

    def found(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.flatnonzero(total)
        return index.astype(np.int32), total[index]

    def together(group: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        numbers, at = gram_numbers("".join(group)), 0
        for n in map(len, group):
            total = np.zeros(FEATURES, np.int64)
            for k, features in enumerate(numbers):
                if n > k:
                    total += np.bincount(features[at : at + n - k], minlength=FEATURES)
            at += n
            yield found(total)

    group, held = [], 0
    for text in map(str.lower, texts):
        if group and held + len(text) > CHUNK:
            yield from together(group)
            group, held = [], 0
        if len(text) <= CHUNK:
            group.append(text)
            held += len(text)
            continue
        total = np.zeros(FEATURES, np.int64)
        for start in range(0, len(text), CHUNK):
            # two more characters, for the n-grams that start before the piece's end
            for features in gram_numbers(text[start : start + CHUNK + 2]):
                total += np.bincount(features[:CHUNK], minlength=FEATURES)
        yield found(total)
    if group:
        yield from together(group)


def weighted(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of unit length."""
    x = (1 + np.log(counts)) * idf[index]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(index, counts, self.idf) @ self.weights[index] + self.bias

    def predict(self, index: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        p = softmax(self.logits(index, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, languages: list[str], seed: int = 11) -> Model:
    """Fits the weights on four fifths of the rows, the temperature on the rest."""
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: len(rows) // 5]
    number = {x: i for i, x in enumerate(languages)}
    data = [(number[lang], index, weighted(index, counts, idf)) for lang, index, counts in rows]
    k = len(languages)
    z, n = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
    bias = np.zeros(k)

    def weights(index: np.ndarray) -> np.ndarray:
        zi = z[index]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[index])) / ALPHA + L2))

    for epoch in range(EPOCHS):
        for row in np.random.default_rng(seed + epoch).permutation(order[len(held) :]):
            label, index, x = data[row]
            w = weights(index)
            error = softmax(x @ w + bias)
            error[label] -= 1
            g = x[:, None] * error
            grown = n[index] + g * g
            z[index] += g - (np.sqrt(grown) - np.sqrt(n[index])) / ALPHA * w
            n[index] = grown
            bias -= 0.02 * error
    model = Model(languages, idf, weights(np.arange(FEATURES)), bias)
    tests = [(data[i][0], model.logits(rows[i][1], rows[i][2])) for i in (held if len(held) else order)]

    doubt = 1 / (len(tests) + 2)  # else a perfect fit would have no finite temperature

    def loss(t: float) -> float:
        total = 0.0
        for label, logits in tests:
            p = np.log(np.maximum(softmax(logits / t), 1e-300))
            total -= (1 - doubt) * p[label] + doubt * p.mean()
        return total

    low, high = math.log(0.02), math.log(20.0)
    for _ in range(40):  # golden section on the logarithm
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if loss(math.exp(a)) < loss(math.exp(b)) else (a, high)
    return Model(languages, idf, model.weights, bias, math.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from text and lang of the documents that aren't held out; None if there is
    no labelled one. To the driver go one blob of document frequencies from a few merging
    tasks, a row for each language, and about ``per_language`` rows of features for each."""
    spark = docs.sparkSession
    short_batches(spark)
    known = docs.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    merges = max(1, math.isqrt(known.rdd.getNumPartitions()))

    def frequencies(batches):
        cache_of("langid")
        seen, rows = np.zeros(FEATURES + 1, np.int64), {}
        for batch in slices(batches, most=SLICE):
            keep = [(t, x) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            for (index, _), (_, lang) in zip(counts_of([t for t, _ in keep]), keep, strict=True):
                seen[index] += 1
                seen[FEATURES] += 1
                rows[lang] = rows.get(lang, 0) + 1
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() % merges
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([list(rows.items())], pa.map_(pa.string(), pa.int64()))], names=["key", "seen", "rows"])

    def added(batches):
        seen, rows = np.zeros(FEATURES + 1, np.int64), {}
        for batch in batches:
            for blob, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen += np.frombuffer(blob, np.int64)
                for lang, n in found:
                    rows[lang] = rows.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([seen.tobytes()], pa.binary()), pa.array([list(rows.items())], pa.map_(pa.string(), pa.int64()))], names=["key", "seen", "rows"])

    shape = "key int, seen binary, rows map<string,bigint>"
    seen, rows = np.zeros(FEATURES + 1, np.int64), {}
    for r in known.select("text", "lang").mapInArrow(frequencies, shape).repartition(merges, "key").mapInArrow(added, shape).collect():
        seen += np.frombuffer(bytes(r["seen"]), np.int64)
        for lang, n in r["rows"].items():
            rows[lang] = rows.get(lang, 0) + n
    if not rows:
        return None
    idf = np.log((1 + seen[FEATURES]) / (1 + seen[:FEATURES])) + 1
    rates = spark.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in rows.items()], "lang string, rate double")
    draw = (F.xxhash64(F.lit(3), "doc_id", "text") % 1_000_000 + 1_000_000) / 2_000_000
    sample = known.join(F.broadcast(rates), "lang").filter(draw < F.col("rate")).select("text", "lang")

    def features(batches):
        for batch in slices(batches, most=SLICE):
            keep = [(t, x) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            found = list(counts_of([t for t, _ in keep]))
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in keep], pa.string()), pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())], names=["lang", "index", "counts"])

    drawn = [(r["lang"], bytes(r["index"]), bytes(r["counts"])) for r in sample.mapInArrow(features, "lang string, index binary, counts binary").collect()]
    drawn.sort()  # the same model whatever the partitions
    fitted = [(lang, np.frombuffer(i, np.uint16).astype(np.int32), np.frombuffer(c, np.uint32).astype(np.int64)) for lang, i, c in drawn]
    return train(fitted, idf, sorted({lang for lang, _, _ in fitted})) if fitted else None


def identify(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its calibrated probability. ``und`` with
    score 0 if the text is null or has no letter, or if there is no model. Columns of these
    names are replaced."""
    short_batches(docs.sparkSession)
    kept = docs.drop(lang, score)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{lang}` string", f"`{score}` double"]
    at = kept.columns.index(text)

    def run(batches):
        cache_of("langid")
        for batch in slices(batches, text, SLICE):
            texts = batch.column(at).to_pylist()
            some = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            for i, (index, counts) in zip(some, counts_of([texts[i] for i in some]), strict=True):
                out[i] = model.predict(index, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=[*batch.schema.names, lang, score])

    return kept.mapInArrow(run, ", ".join(schema))
