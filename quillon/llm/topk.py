"""Exact top-k inner-product search by dual cover trees.

Data and queries are dealt to cells, each around the nearest of some drawn pivots, and
cells to blocks of bounded size. For centres q and r and covering radii a and b no inner
product of members exceeds q.r + a |r| + b |q| + a b. Each query cell first meets the data
cell that may hold most, which gives its worst kth score; of the other pairs of cells only
those whose bound reaches it are shuffled together. A pair of blocks is one group, in which
a cover tree is built over either side, and the search walks pairs of nodes under the same
bound. The best of each group are merged by query.

Components are integers, and products are computed in float64, which is exact while every
score stays below 2^53; blocks with larger ones are scored in whole numbers of any size.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise

DATA_BLOCK, QUERY_BLOCK, LEAF = 8192, 2048, 64
#: Cells of either side: what the driver holds of them, and of their pairs, is bounded.
PIVOTS = 256
EXACT = float(1 << 52)


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    members: np.ndarray | None = None  # of a leaf
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf  # of a query node: its members' worst kth score

    def __post_init__(self):
        self.norm = float(np.sqrt(self.centre @ self.centre))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """Levels halve: a node of level i covers its members within 2^i of its centre, its
    children's centres stand more than 2^(i-1) apart. A node becomes a leaf when it is small
    or its members are equal. Where a level would be mostly single members, as with vectors of
    many dimensions that lie everywhere, its members go to the nearest of a few centres
    instead, each with the radius that covers them."""

    def distances(members: np.ndarray, c: int) -> np.ndarray:
        delta = x[members] - x[c]
        return np.sqrt(np.einsum("ij,ij->i", delta, delta))

    def few(members: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        centres = members[:: max(1, len(members) // max(2, min(16, len(members) // leaf)))]
        near, far = nearest(x[members], x[centres])
        return [(int(c), members[near == i], far[near == i]) for i, c in enumerate(centres) if (near == i).any()]

    def build(members: np.ndarray, centre: int, far: np.ndarray) -> Node:
        radius = float(far.max())
        if len(members) <= leaf or radius == 0:
            return Node(x[centre], radius, np.sort(members))
        step = 2.0 ** (np.ceil(np.log2(radius)) - 1)
        while True:
            groups, left, left_far, c = [], members, far, centre
            while len(left):
                near = left_far <= step
                groups.append((c, left[near], left_far[near]))
                left = left[~near]
                if not len(left):
                    break
                if len(groups) > max(8, len(members) // 8):
                    groups = few(members)
                    break
                c = int(left[0])
                left_far = distances(left, c)
            if len(groups) > 1:
                return Node(x[centre], radius, None, [build(m, c, f) for c, m, f in groups])
            if step < radius / 1024:  # equal but for a few that the nearest centre takes again
                return Node(x[centre], radius, np.sort(members))
            step /= 2

    every = np.arange(len(x))
    return build(every, 0, distances(every, 0))


class Best:
    """The k best of each query: scores and ids, best first, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        if scores.shape[1] > 4 * k:
            # ids ascend along a row, so place breaks ties; all of a row's k best stay
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            floor = np.maximum(kth, self.scores[rows, -1])
            keep = (scores >= floor[:, None]).any(axis=0)
            scores, ids = scores[:, keep], ids[keep]
        every = np.concatenate([self.scores[rows], scores], axis=1)
        names = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((names, -every), axis=1)[:, :k]
        self.scores[rows] = np.take_along_axis(every, order, axis=1)
        self.ids[rows] = np.take_along_axis(names, order, axis=1)


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, leaf: int = LEAF, seen: list[int] | None = None) -> list[tuple[int, int, int]]:
    """query id, data id and score of the k best of each query; both sides in integers as
    float64. A row of ``data`` with a query's id is not its candidate. ``seen`` counts the
    pairs that are scored."""
    best = Best(len(queries), k)
    order = np.argsort(data_ids, kind="stable")
    data, data_ids = data[order], data_ids[order]
    most = max((float(np.abs(m).max()) for m in (queries, data) if m.size), default=0.0)
    if most * most * max(1, queries.shape[1]) >= EXACT:
        return exact(queries, query_ids, data, data_ids, k)

    def bound(q: Node, r: Node) -> float:
        return float(q.centre @ r.centre) + q.radius * r.norm + r.radius * q.norm + q.radius * r.radius

    def visit(q: Node, r: Node, most: float) -> None:
        if most * (1 + 1e-9) + 0.5 < q.worst:  # scores are integers: half is slack for rounding
            return
        if q.members is not None and r.members is not None:
            scores, ids = queries[q.members] @ data[r.members].T, data_ids[r.members]
            if seen is not None:
                seen.append(scores.size)
            scores[query_ids[q.members][:, None] == ids] = -np.inf
            best.offer(q.members, scores, ids)
            q.worst = float(best.scores[q.members, -1].min())
            return
        if q.members is None and (r.members is not None or q.radius >= r.radius):
            for child in q.children:
                child.worst = max(child.worst, q.worst)
                visit(child, r, bound(child, r))
            q.worst = min(c.worst for c in q.children)
            return
        for most_, _, child in sorted(((bound(q, c), i, c) for i, c in enumerate(r.children)), reverse=True):
            visit(q, child, most_)

    if len(queries) and len(data):
        a, b = cover_tree(queries, max(1, leaf // 8)), cover_tree(data, leaf)
        visit(a, b, bound(a, b))
    kept = best.scores > -np.inf
    return [(int(query_ids[i]), int(best.ids[i, j]), int(best.scores[i, j])) for i, j in zip(*np.nonzero(kept), strict=True)]


def exact(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, rows: int = 256) -> list[tuple[int, int, int]]:
    """The same in whole numbers of any size, a few rows of data at a time."""
    asks = [[int(v) for v in q] for q in queries]
    best: list[list[tuple[int, int]]] = [[] for _ in asks]
    for start in range(0, len(data), rows):
        some = [([int(v) for v in x], int(j)) for x, j in zip(data[start : start + rows], data_ids[start : start + rows], strict=True)]
        for i, (q, name) in enumerate(zip(asks, query_ids.tolist(), strict=True)):
            best[i] = sorted([*best[i], *((-sum(map(mul, q, x)), j) for x, j in some if j != name)])[:k]
    limit = 10**38 - 1  # of what a score travels in; beyond a long it is cut in any case
    return [(int(name), j, max(-limit, min(limit, -s))) for name, found in zip(query_ids.tolist(), best, strict=True) for s, j in found]


def usable(vector: str, row_id: str) -> Column:
    """Neither null nor with a component that is null or not finite."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * 256) < float("inf")))
    return F.col(row_id).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest pivot, and the distance."""
    apart = np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0)
    cell = apart.argmin(axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def top_k(table: DataFrame, is_query: Column, k: int = 5, row_id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each row of ``table`` with
    ``is_query``, by the inner product of floor(scale * component). Fewer than k candidates:
    all of them. Only vectors of one length are compared. Of repeated query ids the least
    vector asks; repeated candidate rows each count. Vectors with null or non-finite
    components, or without an id, take no part; an empty table gives no rows. Scores rank
    exactly; one beyond a long is given as the nearest long."""
    spark = table.sparkSession
    rows = table.filter(usable(vector, row_id)).select(F.col(row_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    most = [min(PIVOTS, max(1, n // block)) for n, block in ((sizes["n"], data_block), (sizes["q"], query_block))]
    drawn = rows.orderBy(F.xxhash64(F.lit(7), "vec_id", "v")).limit(max(most)).collect()  # PIVOTS vectors at most
    vectors: dict[int, list] = {}
    for r in drawn:
        vectors.setdefault(len(r["v"]), []).append(np.floor(scale * np.asarray(r["v"], float)))
    pivots = {width: np.array(found).reshape(len(found), width) for width, found in vectors.items()}

    def deal(batches):
        for batch in batches:
            values = batch.column(1)
            offsets = values.offsets.to_numpy().astype(np.int64)
            width = np.diff(offsets)
            flat = np.floor(scale * values.values.to_numpy(zero_copy_only=False))
            cells, fars = np.full((2, len(batch)), -1, np.int32), np.full((2, len(batch)), np.inf)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                x = flat[offsets[at][:, None] + np.arange(w)] if w else np.empty((len(at), 0))
                for i in (0, 1):
                    if w in pivots:
                        cells[i, at], fars[i, at] = nearest(x, pivots[w][: most[i]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width.astype(np.int32)), pa.array(cells[0]), pa.array(fars[0]), pa.array(cells[1]), pa.array(fars[1])], names=["vec_id", "v", "asks", "width", "d", "d_far", "q", "q_far"])

    dealt = materialise(rows.mapInArrow(deal, "vec_id long, v array<double>, asks boolean, width int, d int, d_far double, q int, q_far double"), "dealt")
    # a row for each cell: PIVOTS for each length of vectors at most
    data = {(r["width"], r["d"]): (r["n"], r["far"]) for r in dealt.groupBy("width", "d").agg(F.count("*").alias("n"), F.max("d_far").alias("far")).collect()}
    asked = {(r["width"], r["q"]): (r["n"], r["far"]) for r in dealt.filter("asks").groupBy("width", "q").agg(F.count("*").alias("n"), F.max("q_far").alias("far")).collect()}
    parts = lambda n, block: -(-n // block)

    def most_of(width: int, q: int, d: int) -> float:
        """What no inner product of a query cell's and a data cell's vectors exceeds."""
        if q < 0 or d < 0:
            return np.inf
        a, b, r, s = pivots[width][q], pivots[width][d], asked[width, q][1], data[width, d][1]
        return float(a @ b + r * np.sqrt(b @ b) + s * np.sqrt(a @ a) + r * s)

    def cell(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks").to_pylist(), bool)
        ids = group.column("vec_id").to_numpy()
        values = group.column("v").combine_chunks()
        x = np.floor(scale * values.flatten().to_numpy(zero_copy_only=False)).reshape(len(ids), -1) if len(ids) else np.empty((0, 0))
        found = search(x[asks], ids[asks], x[~asks], ids[~asks], k, leaf)
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.decimal128(38, 0))})

    asking = dealt.filter("asks").groupBy("vec_id").agg(F.min(F.struct("v", "width", "q")).alias("x")).select("vec_id", "x.*")

    def searched(pairs: list[tuple[int, int, int, int]]) -> DataFrame:
        """The best of each pair of a query cell and a part of a data cell (width, q, d, part)."""
        met = F.broadcast(spark.createDataFrame([(w, q, d, part, parts(asked[w, q][0], query_block), parts(data[w, d][0], data_block)) for w, q, d, part in pairs], "width int, q int, d int, part int, q_parts int, d_parts int"))
        own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.col(n)).cast("int")
        left = asking.join(met, ["width", "q"]).withColumn("q_part", own(1, "q_parts")).withColumn("asks", F.lit(True))
        right = dealt.drop("q", "asks").join(met, ["width", "d"]).filter(own(2, "d_parts") == F.col("part"))
        right = right.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1))).withColumn("asks", F.lit(False))
        names = ["width", "q", "q_part", "d", "part"]
        return left.select(*names, "asks", "vec_id", "v").unionByName(right.select(*names, "asks", "vec_id", "v")).groupBy(*names).applyInArrow(cell, "query_id long, vec_id long, score decimal(38,0)")

    # first each query cell meets the data cell that may hold most, which gives its worst kth score
    near = {(w, q): max((d for x, d in data if x == w), key=lambda d, w=w, q=q: most_of(w, q, d)) for w, q in asked}
    first = [(w, q, d, 0) for (w, q), d in near.items()]
    rest = [(w, q, d, part) for w, q in asked for x, d in data if x == w for part in range(parts(data[w, d][0], data_block)) if part or d != near[w, q]]
    found = searched(first)
    if rest:
        found = materialise(found, "first")
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        worst = asking.join(kth, F.col("vec_id") == F.col("query_id"), "left").groupBy("width", "q").agg(F.min(F.when(F.col("n") >= k, F.col("worst").cast("double")).otherwise(float("-inf"))).alias("worst"))
        floor = {(r["width"], r["q"]): r["worst"] for r in worst.collect()}
        rest = [p for p in rest if most_of(*p[:3]) * (1 + 1e-9) + 0.5 >= floor.get(p[:2], -np.inf)]
        found = found.unionByName(searched(rest)) if rest else found
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    low, high = (F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1))
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", F.greatest(low, F.least(high, "score")).cast("long").alias("score"))
