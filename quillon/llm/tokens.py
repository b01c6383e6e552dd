"""Token counts by heap-and-linked-list byte-pair merging.

A text is its initial symbols (characters; a character without a piece of its own is one
symbol for each UTF-8 byte) and a doubly linked list over them. A heap holds the adjacent
pairs that form a piece, lowest rank first, then leftmost; popping one merges it and may
add its new neighbours. The count is the initial symbols less the merges: no identifier is
looked up or emitted.

No piece of the vocabulary joins a word to a following space or reaches over a character
without a piece, so a text falls into units (spaces and the word after them) that merge
independently; a unit that was counted before comes from a cache of bounded size.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cache_of, short_batches, slices

SPACE = "▁"


class Pieces:
    """Ranks of the pieces of a byte-fallback BPE model; lower merges first."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = {piece.replace(SPACE, " "): rank for piece, rank in ranks.items()}
        apart = [p for p in self.ranks if p.strip(" ") and " " in p[1:]]
        if apart:
            raise ValueError(f"pieces with a space after their start: {apart[:5]}")
        # a line break without a piece never merges, so it ends a unit
        stop = "" if any("\n" in p for p in self.ranks) else "\n"
        self.units = re.compile(rf"{stop}| *[^ {stop}]+| +" if stop else " *[^ ]+| +")

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
        return cls({model.id_to_piece(i): rank for rank, i in enumerate(sorted(kept, key=lambda i: (-model.get_score(i), i)))})

    def count_unit(self, unit: str) -> int:
        """Tokens of a text without splitting it: heap and linked list."""
        ranks, parts, n = self.ranks, list(unit), len(unit)
        count = sum(1 if c in ranks else len(c.encode()) for c in parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i) for i in range(n - 1) if (pair := parts[i] + parts[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or ranks.get(parts[i] + parts[j]) != rank:
                continue  # one of the pair has merged since
            parts[i] += parts[j]
            parts[j] = ""
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (rank, i))
            if (h := before[i]) >= 0 and (rank := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (rank, h))
        return count


class Counter(dict):
    """Counts by unit, in two generations: when the young one is full, the old one goes."""

    FULL, LONG = 600_000, 40

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.old = pieces, {}

    def __missing__(self, unit: str) -> int:
        n = self.old.get(unit)
        if n is None:
            n = self.pieces.count_unit(unit)
        if len(unit) <= self.LONG:
            self[unit] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text: a space goes before it, none for an empty one."""
        if not text:
            return 0
        if len(self) > self.FULL:
            self.old = dict(self)
            self.clear()
        return sum(map(self.__getitem__, self.pieces.units.findall(" " + text.replace(SPACE, " "))))


def counter(path: str) -> Counter:
    """One for each model and Python worker."""
    kept = cache_of("tokens")
    if path not in kept:
        kept[path] = Counter(Pieces.load(path))
    return kept[path]


def count_tokens(docs: DataFrame, model_path: str, over: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row. Null text counts as empty:
    0 bytes, 0 tokens. Repeated rows are counted each; other columns are not read."""
    short_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        tokens = counter(model_path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            n = [tokens.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > over for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
