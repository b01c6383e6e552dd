"""Stupid-backoff scores, computed relationally.

The n-gram count table is partitioned by n-gram hash, and so are the documents' n-grams:
each task that reads a stretch of documents sends every bucket the distinct hashes of the
stretch that fall into it, sorted, with their counts (one packed, compressed row for a
stretch, order and bucket). A bucket adds up the counts, which is its part of the table,
joins them to what it was sent, and returns the table's counts in the same order. Where the
stretch's texts meet these, each word is scored, and the scores are summed by document.

Every row is scored against all the other rows: its own counts are taken off the table's.
A word's score is f(n-gram) / f(n-gram without the word) for the longest n-gram of up to
``order`` words that ends in it, lies within the document and occurs elsewhere, times
``BACKOFF`` for each longer one; a word that occurs nowhere else counts as seen once among
all other rows' words. ``score_new`` scores documents against a given count table.
Logarithms are summed as integers of 1e-6, so sums don't depend on their order.

An n-gram has one entry for each stretch that holds it, however many documents do, so the
most frequent ones bring no bucket more than the number of stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, mix64, only, slices, written
from quillon.llm.packed import CODEC, pack, ranges, unpack
from quillon.llm.shingles import PLACE, words

ORDER, BACKOFF, UNIT = 3, 0.4, 1_000_000
ALPHA = round(float(np.log(BACKOFF)) * UNIT)
#: Of the compression of texts, which are shuffled once.
LEVEL = 6
#: Text bytes of a stretch, of what is hashed at once, and of all texts for each bucket.
STRETCH, SLICE, BUCKET = 8 << 20, 1 << 18, 16 << 20


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-gram that starts at each word."""
    if k == 1:
        return hashes
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        out += hashes[i : i + len(out)] * PLACE[i]
    return mix64(out)


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and rows of a stretch, hashed in small slices for the memory's sake."""
    found, rows, first = [], [], 0
    for part in slices(iter([batch]), most=SLICE):
        hashes, at = words(part.column(part.schema.get_field_index("text")))
        found.append(hashes)
        rows.append(at + first)
        first += part.num_rows
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def within(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-grams that lie within a row, and the words at which they begin."""
    at = np.arange(max(0, len(hashes) - k + 1))
    at = at[rows[at] == rows[at + k - 1]] if k > 1 else at
    return grams(hashes, k)[at], at


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows in stretches of about ``STRETCH`` bytes of text, whatever batches bring them,
    each with a name made from its contents."""
    held, size = [], 0

    def joined() -> tuple[int, pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        name = xxhash.xxh3_64()
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer() or b""
            name.update(b"%d:%d:" % (-1 if doc is None else doc, len(raw)))
            name.update(raw)
        return name.intdigest() - (1 << 63), batch

    for part in slices(batches, most=STRETCH):
        more = part.column(1).nbytes
        if held and size + more > STRETCH:
            yield joined()
            held, size = [], 0
        held.append(part)
        size += more
    if held:
        yield joined()


def logs(counts: np.ndarray) -> np.ndarray:
    return np.rint(np.log(np.maximum(counts, 1)) * UNIT).astype(np.int64)


def repeated(values: np.ndarray, heads: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A value for each run of sorted entries, brought back to the entries' own order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(values, np.diff(np.r_[np.flatnonzero(heads), len(order)]))
    return out


def scored(hashes: np.ndarray, rows: np.ndarray, n_rows: int, table: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By row, the sum of its words' scores without log(other rows' words), and how often
    that is to be taken off. ``table`` has by order the counts, in the whole corpus, of the
    distinct n-grams in the order of their hashes."""
    n = len(hashes)
    place = np.arange(n) - np.searchsorted(rows, rows)  # in the row
    longest = np.minimum(place + 1, len(table))
    score, bare, lower = np.zeros(n, np.int64), np.ones(n, bool), None
    for k, counts in enumerate(table, 1):
        gram, at = within(hashes, rows, k)
        order = np.argsort(gram, kind="stable")  # rows ascend within an n-gram
        gram, row = gram[order], rows[at][order]
        first = np.ones(len(gram), bool)
        first[1:] = gram[1:] != gram[:-1]
        if int(first.sum()) != len(counts):
            raise RuntimeError("the texts were not the same when they were read again")
        own = first.copy()
        own[1:] |= row[1:] != row[:-1]
        # the row's own occurrences are taken off
        rest = np.zeros(n, np.int64)
        rest[at] = repeated(counts, first, order) - repeated(np.diff(np.r_[np.flatnonzero(own), len(gram)]), own, order)
        log, seen = logs(rest), np.flatnonzero(rest > 0)
        end = seen + k - 1
        if k == 1:
            score = log + (longest - 1) * ALPHA
        else:
            score[end] = log[seen] - lower[seen] + (longest[end] - k) * ALPHA
            bare[end] = False
        lower = log
    sums, times = np.zeros(n_rows, np.int64), np.bincount(rows[bare], minlength=n_rows)
    np.add.at(sums, rows, score)
    return sums, times


def score_corpus(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (long, sum of natural logarithms in units of 1e-6) and
    mean_log (long: log_score by word, rounded down; null without words) for every row,
    scored against all other rows. Words are runs of other than ASCII white space, A-Z
    lower-cased; null text has none. Repeated rows are other rows to each other; an empty
    table gives no rows. ``docs`` is read twice; unless it is a plain scan, it is written
    first, and a second reading that differs is an error."""
    mark = written()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = materialise(rows, "texts")
    total_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total_bytes // BUCKET))

    def heads(batches):
        """The ids and texts of each stretch."""
        for name, batch in stretches(batches):
            texts = batch.column(1).to_pylist()
            raw = [t.encode() for t in texts]
            blob = pa.Codec(CODEC, compression_level=LEVEL).compress(b"".join(raw), asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([list(map(len, raw))], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["stretch", "ids", "sizes", "texts"])

    def explode(batches):
        for name, batch in stretches(batches):
            hashes, at = words_of(batch)
            for k in range(1, order + 1):
                gram, counts = np.unique(within(hashes, at, k)[0], return_counts=True)
                # hashes ascend, so a bucket is a stretch of them
                cut, number = ranges(gram, buckets)
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                packed = [pack(gram[a:b], counts[a:b]) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(spans), pa.int64()), pa.array([k] * len(spans), pa.int32()), pa.array(number, pa.int64()), pa.array(np.diff(cut), pa.int32()), pa.array(packed, pa.binary())], names=["stretch", "k", "bucket", "n", "packed"])

    def count(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        parts = [unpack(p, n, 1) for p, n in zip(table.column("packed").to_pylist(), sizes, strict=True)]
        gram = np.concatenate([p[0] for p in parts])
        _, which = np.unique(gram, return_inverse=True)
        # the count table of this bucket, in the order of what was sent
        f = np.zeros(int(which.max()) + 1, np.int64)
        np.add.at(f, which, np.concatenate([p[1].view(np.uint32) for p in parts]).astype(np.int64))
        found, at = [], 0
        for n in sizes:
            places = f[which[at : at + n]].view(np.uint8).reshape(-1, 8).T
            found.append(pa.compress(np.ascontiguousarray(places).tobytes(), codec=CODEC, asbytes=True))
            at += n
        return pa.table({"stretch": table.column("stretch"), "k": table.column("k"), "bucket": table.column("bucket"), "n": table.column("n"), "counts": pa.array(found, pa.binary())})

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        known: list[dict[int, tuple[int, bytes]]] = [{} for _ in range(order)]
        for k, bucket, n, blob in zip(*(right.column(c).to_pylist() for c in ("k", "bucket", "n", "counts")), strict=True):
            known[k - 1][bucket] = n, blob
        if right.num_rows and not left.num_rows:
            raise RuntimeError("the texts were not the same when they were read again")
        out = []
        for ids, sizes, blob in zip(*(left.column(c).to_pylist() for c in ("ids", "sizes", "texts")), strict=True):
            raw = pa.decompress(blob, decompressed_size=sum(sizes), codec=CODEC)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            texts = pa.Array.from_buffers(pa.string(), len(ids), [None, offsets.buffers()[1], raw])
            hashes, at = words_of(pa.RecordBatch.from_arrays([texts], names=["text"]))
            table = []
            for k in range(1, order + 1):
                parts = [np.empty(0, np.int64)]
                for bucket in sorted(known[k - 1]):
                    n, packed = known[k - 1][bucket]
                    places = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec=CODEC, asbytes=True), np.uint8)
                    parts.append(np.ascontiguousarray(places.reshape(8, n).T).view(np.int64).ravel())
                table.append(np.concatenate(parts))
            sums, bare = scored(hashes, at, len(ids), table)
            out.append((ids, np.bincount(at, minlength=len(ids)), sums, bare))
        columns = [np.concatenate(x) for x in list(zip(*out, strict=True))[1:]] or [np.empty(0, np.int64)] * 3
        ids = [x for found in out for x in found[0]]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("doc_id", "n_words", "sum", "bare"), (ids, *columns), strict=True)})

    # shuffled as they are made: written copies would double the disk
    sent = rows.mapInArrow(explode, "stretch long, k int, bucket long, n int, packed binary")
    texts = rows.mapInArrow(heads, "stretch long, ids array<long>, sizes array<long>, texts binary")
    counted = sent.groupBy("k", "bucket").applyInArrow(count, "stretch long, k int, bucket long, n int, counts binary")
    summed = texts.groupBy("stretch").cogroup(counted.groupBy("stretch")).applyInArrow(add, "doc_id long, n_words long, sum long, bare long")
    return finished(only(summed, "scores", mark))


def finished(summed: DataFrame) -> DataFrame:
    """Takes log(other rows' words) off each of the ``bare`` words, whose score has no
    context, and adds the mean."""
    whole = summed.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    rest = F.rint(F.log(F.greatest(F.lit(whole) - F.col("n_words"), F.lit(1)).cast("double")) * UNIT).cast("long")
    score = F.col("sum") - rest * F.col("bare")
    mean = F.when(F.col("n_words") > 0, F.floor(score.cast("double") / F.col("n_words")).cast("long"))
    return summed.select("doc_id", "n_words", score.alias("log_score"), mean.alias("mean_log"))


def _split(text: str):
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def count_tables(corpus: DataFrame, order: int = ORDER) -> DataFrame:
    """The count table of a corpus: gram (its words joined by spaces) and f, with the
    number of all words as the gram of no words."""
    listed = corpus.select(_split("text").alias("w"))
    every = [F.expr(f"transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' '))") for k in range(1, order + 1)]
    guarded = [F.when(F.size("w") >= k, e).otherwise(F.expr("cast(array() as array<string>)")) for k, e in enumerate(every, 1)]
    words_ = F.transform("w", lambda w: F.lit(""))
    return listed.select(F.explode(F.concat(words_, *guarded)).alias("gram")).groupBy("gram").agg(F.count("*").alias("f"))


def score_new(docs: DataFrame, table: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id and log_score (double) of documents that need not be of the corpus: the
    longest seen n-gram of each word counts, ``backoff`` for each shorter one tried; words
    that were never seen count as seen once. doc_id must tell the rows apart."""
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _split("text").alias("w"))
    spots = listed.select("doc_id", "w", F.posexplode("w").alias("i", "word"))
    tries = F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.col("i") + 1))).alias("k")
    wide = spots.select("doc_id", "i", "w", tries).select("doc_id", "i", "k", F.expr("array_join(slice(w, i - k + 2, k), ' ')").alias("gram"), F.expr("array_join(slice(w, i - k + 2, k - 1), ' ')").alias("context"))
    seen = wide.join(table.select("gram", F.col("f").alias("f")), "gram", "left").join(table.select(F.col("gram").alias("context"), F.col("f").alias("c")), "context", "left")
    found = F.when(F.col("f").isNotNull(), F.struct(F.col("k"), (F.log("f") - F.log("c")).alias("log")))
    each = seen.groupBy("doc_id", "i").agg(F.max(found).alias("best"), F.max("k").alias("longest"), F.max(F.when(F.col("k") == 1, F.col("c"))).alias("n"))
    log = F.coalesce(F.col("best.log") + (F.col("longest") - F.col("best.k")) * F.log(F.lit(backoff)), F.log(1 / F.col("n")) + (F.col("longest") - 1) * F.log(F.lit(backoff)))
    sums = each.groupBy("doc_id").agg(F.sum(log).alias("log_score"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(sums, "doc_id", "left").select("doc_id", F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
