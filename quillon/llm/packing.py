"""Best-fit packing by the linear grouping scheme.

A piece's length is at most the capacity, so the lengths of any corpus are a histogram of
``capacity`` bins; the whole plan is made from it on the driver, and its size depends on
the capacity alone. Large lengths are sorted and cut into groups of equal cardinality,
each rounded up to its longest; column generation (a simplex whose columns come from a
knapsack) finds configurations of these few sizes; the configurations take actual
documents group by group; what is left, small documents first of all, goes where it fits
best. A plan row places a run of pieces of one length, given by their ranks in it, into
equal sequences; ranks come from a shuffle on (length, salt), so no length meets in one
task.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cache_of, materialise, short_batches, slices

CAPACITY = 4096
#: Group counts, and the least large length as a divisor of the capacity: each pair gives a
#: plan, the one with the fewest sequences is taken; none is tried after one that reaches
#: the lower bound, all tokens over the capacity.
VARIANTS = ((24, 3), (40, 4), (64, 8))
#: Pieces of one length that one task ranks at least, and such shares in all at most,
#: besides one for each length.
SHARE, SHARES = 1000, 8192


def best_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (how many of each size a sequence holds) and how often each is used, of the
    linear programme min sum(x), patterns x >= demand."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        x = np.linalg.solve(basis, demand.astype(float))
        prices = np.linalg.solve(basis.T, np.ones(k))
        column, worth = _knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, column)
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return basis.round().astype(int), np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The most worthy multiset of sizes that fits. One more item in each step."""
    best, steps = np.zeros(capacity + 1), []
    for _ in range(int(capacity // sizes.min())):
        grown, choice = best.copy(), np.full(capacity + 1, -1, np.int32)
        for i, (s, p) in enumerate(zip(sizes.tolist(), prices.tolist(), strict=True)):
            if p <= 0:
                continue
            more = best[:-s] + p
            better = more > grown[s:] + 1e-12
            grown[s:][better] = more[better]
            choice[s:][better] = i
        steps.append(choice)
        if not (choice >= 0).any():
            break
        best = grown
    column, at = np.zeros(len(sizes)), capacity
    for choice in reversed(steps):
        if choice[at] >= 0:
            column[choice[at]] += 1
            at -= int(sizes[choice[at]])
    return column, float(column @ prices)


class Plan:
    """Rows (length, first rank, count, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, dict(counts)
        self.next_rank: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first sequence, sequences)

    def place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.next_rank[length], count, sequence, each, offset))
        self.next_rank[length] += count
        self.left[length] -= count

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def close(self, sequence: int, n: int, room: int) -> None:
        if n and room:
            self.open[room].append((sequence, n))

    def configure(self, groups: int, least: int) -> None:
        """Linear grouping of the lengths from ``least`` on."""
        lengths = [x for x in sorted(self.left, reverse=True) if least <= x < self.capacity and self.left[x]]
        total = sum(self.left[x] for x in lengths)
        if not total:
            return
        groups = min(groups, total)
        edges = [total * (g + 1) // groups for g in range(groups)]
        members: list[list[list[int]]] = [[]]
        seen = 0
        for x in lengths:
            n = self.left[x]
            while n:
                take = min(n, edges[len(members) - 1] - seen)
                if take:
                    members[-1].append([x, take])
                seen, n = seen + take, n - take
                if seen == edges[len(members) - 1] and len(members) < groups:
                    members.append([])
        # groups of one rounded size are one
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            merged.setdefault(m[0][0], []).extend(m)
        sizes = np.array(list(merged))
        queues = list(merged.values())
        demand = np.array([sum(n for _, n in q) for q in queues])
        columns, uses = best_configurations(sizes, demand, self.capacity)
        for c in range(len(sizes)):
            if m := int(uses[c] + 1e-6):
                self._fill(np.repeat(np.arange(len(sizes)), columns[:, c]).tolist(), queues, m)

    def _fill(self, slots: list[int], queues: list[list[list[int]]], m: int) -> None:
        """m sequences of one configuration: each slot takes the next documents of its group."""
        first, taken = self.new(m), []
        for g in slots:
            runs, need = [], m
            while need and queues[g]:
                x, n = queues[g][0]
                use = min(n, need)
                runs.append((x, use))
                need -= use
                queues[g][0][1] -= use
                if use == n:
                    queues[g].pop(0)
            taken.append(runs + [(0, need)] * bool(need))
        at = 0
        while at < m:  # as far as no slot changes its length
            n = min(r[0][1] for r in taken)
            offset = 0
            for r in taken:
                if r[0][0]:
                    self.place(r[0][0], n, first + at, 1, offset)
                    offset += r[0][0]
            self.close(first + at, n, self.capacity - offset)
            taken = [[(r[0][0], r[0][1] - n), *r[1:]] if r[0][1] > n else r[1:] for r in taken]
            at += n

    def best_fit(self) -> None:
        """All that is left, longest first, where the least room remains."""
        for x in sorted(self.left, reverse=True):
            while n := self.left[x]:
                room = min((r for r, runs in self.open.items() if r >= x and runs), default=0)
                if not room:
                    each = self.capacity // x
                    self.close(self.new(-(-n // each)), -(-n // each), self.capacity)
                    continue
                sequence, m = self.open[room].pop()
                each = room // x
                full = min(m, n // each)
                if full:
                    self.place(x, full * each, sequence, each, self.capacity - room)
                    self.close(sequence, full, room - each * x)
                rest = self.left[x]
                if full < m and 0 < rest < each:
                    self.place(x, rest, sequence + full, rest, self.capacity - room)
                    self.close(sequence + full, 1, room - rest * x)
                    full += 1
                self.close(sequence + full, m - full, room)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, variants=VARIANTS) -> Plan:
    """The plan with the fewest sequences among the variants."""
    best, bound = None, -(-sum(x * n for x, n in counts.items()) // capacity)
    for groups, part in variants:
        plan = Plan(counts, capacity)
        plan.configure(groups, capacity // part)
        plan.best_fit()
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best


# --- pieces -----------------------------------------------------------------------------

# Characters whose normal form, case, class and white space are the same in
# every Unicode version and library: ASCII text and Latin letters. Other texts, and texts
# that may hold a special token, take the library's own path.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ɏ]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")


class WordIds(dict):
    """The bytes (little-endian 32-bit ids) of a text by a tokenizer that splits texts into
    words first; words come from a cache in two generations, of about 100 MB each at most."""

    FULL, LONG = 500_000, 40

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.old = Tokenizer.from_file(path), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._whole(word)
        if len(word) <= self.LONG:
            self[word] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(self) > self.FULL:
            self.old = dict(self)
            self.clear()
        if "<|" in text or not PLAIN.fullmatch(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, WORDS.findall(text.lower())))


def word_ids(path: str) -> WordIds:
    """One for each tokenizer and Python worker."""
    kept = cache_of("packing")
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity``; the last piece
    may be shorter. Null text counts as empty and gives one piece of one id."""
    short_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        ids_of, end = word_ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids_of.encode(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return narrow.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their sequence and offset. Repeated rows are
    packed each. An empty table gives no rows."""
    spark = docs.sparkSession
    pieces = materialise(pieces_of(docs, tokenizer_path, capacity), "pieces")
    # a row for each length that occurs: at most ``capacity``
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(counts, capacity)
    share = max(SHARE, sum(counts.values()) // SHARES)
    salts = spark.createDataFrame([(x, max(1, -(-n // share))) for x, n in counts.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    # at most SHARES rows, and one for each length
    ranked = salted.withColumn("own", own).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    table = spark.createDataFrame(plan.rows, "at_length long, first_rank long, n long, first_sequence long, each long, at long")
    step = F.col("rank") - F.col("first_rank")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("at_length")) & (step >= 0) & (step < F.col("n")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
