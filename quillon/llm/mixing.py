"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. Targets share the total by weight, none above ``MOST`` times its source.
Equal-word blocks go to sources by highest quotients, and a source's blocks to its shards
in the same way, which gives integer quotas; a shard takes its quota as whole passes over
its blocks and a seeded run of the rest. Documents stand in a shard in seeded order, so a
run of blocks is a random sample of them.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise

#: Weights by rank of the source, repeating, and how often a source may repeat.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of the smallest source at least, as far as it has words.
LEAST_BLOCKS = 100
#: Words of a block at most, of a shard at least; shards at most besides one for each source.
BLOCK, SHARD, SHARDS = 4096, 1_000_000, 16_384


def targets(sizes: list[int], weights: list[int], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight; what is above ``most`` times a size is shared again
    by weight among the rest, until none is above."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in above)
        open_ -= set(above)
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1); a party at its cap takes no more. Ties
    go to the first. Starts from the rounded shares, which are off by less than a seat a
    party, so the work doesn't grow with the seats."""
    n = len(votes)
    caps = caps or [seats] * n
    total = sum(votes)
    if not total:
        return [0] * n
    got = [min(caps[i], max(0, int(seats * votes[i] / total) - 1)) for i in range(n)]
    left = min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v)) - sum(got)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(n) if votes[i] and got[i] < caps[i]]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: int
    target: float


def sources_of(sized: DataFrame) -> list[Source]:
    """The sources in code point order, null last. One row for each source goes to the driver."""
    rows = [(r["source"], int(r["n"])) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    goals = targets([n for _, n in rows], weights)
    return [Source(name, n, w, t) for (name, n), w, t in zip(rows, weights, goals, strict=True)]


def block_of(sources: list[Source]) -> int:
    """Words of a block: few enough that the smallest source that has words comes near its
    target. Blocks are only counted, so their number costs nothing."""
    total = sum(s.size for s in sources)
    smallest = min((s.size for s in sources if s.size), default=0)
    return max(1, min(BLOCK, total // (1000 * max(1, len(sources))), smallest // LEAST_BLOCKS))


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and copies
    (how often the document's first word is taken) for every row; null text has size 0.
    The same rows give the same result whatever their partitions. Rows that share a doc_id are
    dealt by their texts; an empty table gives no rows. The driver holds a row for each source,
    and tasks get all of them: sources are names of collections, not of pages."""
    spark = docs.sparkSession
    sized = materialise(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of().alias("size"), F.xxhash64("text").alias("words")), "sizes")
    sources = sources_of(sized)
    total = sum(s.size for s in sources)
    block = block_of(sources)
    least = max(SHARD, total // SHARDS)
    shards = [max(1, -(-s.size // least)) for s in sources]
    table = spark.createDataFrame([(s.name, i, shards[i], s.size, s.target) for i, s in enumerate(sources)], "source string, source_no int, shards int, source_size long, target double")
    # a row for each source: as many rows as the driver has just held
    order = F.xxhash64(F.lit(seed), "doc_id", "words")
    dealt = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["source"])).drop(table["source"])
    dealt = dealt.withColumn("order", order).withColumn("shard", F.pmod("order", F.col("shards")).cast("int"))
    # at most SHARDS rows, and one for each source
    found = {(r["source_no"], r["shard"]): int(r["n"]) for r in dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("n")).collect()}
    plan = quotas(sources, found, block, seed)
    plan = spark.createDataFrame(plan, "source_no int, shard int, passes long, a long, b long, c long")
    w = Window.partitionBy("source_no", "shard").orderBy("order", "doc_id", "size")
    placed = dealt.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.col("end") - F.col("size")
    within = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("end"), hi) - F.greatest(begin, lo))
    starts = lambda lo, hi: ((begin >= lo) & (begin < hi)).cast("long")
    zero = F.lit(0).cast("long")
    taken = placed.join(F.broadcast(plan), ["source_no", "shard"]).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + within(F.col("a"), F.col("b")) + within(zero, F.col("c"))).cast("long").alias("taken"),
        (F.col("passes") + starts(F.col("a"), F.col("b")) + starts(zero, F.col("c"))).cast("long").alias("copies"),
    )
    return taken


def quotas(sources: list[Source], sizes: dict[tuple[int, int], int], block: int, seed: int) -> list[tuple]:
    """By (source, shard): whole passes, and the words [a, b) and [0, c) once more."""
    blocks = {k: max(1, round(n / block)) if n else 0 for k, n in sizes.items()}
    by: dict[int, list[tuple[int, int]]] = {}
    for k in sorted(blocks):
        by.setdefault(k[0], []).append(k)
    of = {i: sum(blocks[k] for k in ks) for i, ks in by.items()}
    seats = round(sum(s.target for s in sources) / block)
    got = sainte_lague([s.target for s in sources], seats, [MOST * of.get(i, 0) for i in range(len(sources))])
    plan = []
    for i, ks in by.items():
        shares = sainte_lague([blocks[k] for k in ks], got[i], [MOST * blocks[k] for k in ks])
        for k, q in zip(ks, shares, strict=True):
            n, z = blocks[k], sizes[k]
            passes, rest = divmod(q, n) if n else (0, 0)
            cut = lambda x, n=n, z=z: x * z // n if n else 0
            first = (seed * 2654435761 + k[0] * 40503 + k[1] * 69069) % n if n else 0
            last = first + rest
            a, b, c = cut(first), cut(min(last, n)), cut(max(0, last - n))
            plan.append((*k, passes, a, b, c))
    return plan
