"""N-gram Jaccard join by parity sketches.

A set's sketch flips one bit for each member (its hash names it), so the Hamming distance
of two sketches never exceeds the symmetric difference of the sets. Sets linked at
``percent`` with at most a members in the smaller differ in d = (100 - percent) a / percent
at most, and their sizes by no more than that ratio. So within a size band the sketch is cut
into d + 1 words of 2^32 bits, of which at least one must be equal (pigeonhole): equal words
(held as a linear 64-bit hash, as they are sparse) join. Pairs are then held against a second, narrower sketch, those of
long sets against one as wide as the sets too (a narrow one fills up, and lets all pairs
of long sets pass), and verified on their texts.

Buckets of equal words may be as large as the largest group of near copies, so no bucket's
pairs are all made. Equal sets are one node from the start. First every node is verified
against the most shared node of its buckets only; then only pairs of different components
remain, of which linked ones share many words if they are long, and buckets that hold one
component are done. What still is large is dealt again by the words of an independent
sketch, which any linked pair must share too.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import batches_of, materialise, mix64, only, release, short_batches, slices, written
from quillon.llm.graph import components
from quillon.llm.packed import pack, ranges, unpack
from quillon.llm.shingles import shingle_sets

#: 64-bit words of the narrow sketch, and the largest bucket whose pairs of components are
#: made directly.
SKETCH, SMALL = 8, 4096
#: The most bits of a wide sketch; of longer sets it is a weaker filter.
WIDEST = 1 << 20
#: A sketch word of so many members at most is weak: many unrelated sets share it.
WEAK = 0
#: A bucket of more rows is hot.
HOT = 64
#: Packed entries that a task sends at once, entries of a part, and rows of one bucket that
#: go packed from there; others of a hot bucket go as rows, which Spark can split.
ENTRIES, PART, PACKED = 1_000_000, 1_000_000, 16
#: Rows that are small enough for every task to have them all.
FEW = 500_000
#: Text bytes that pairs may bring to a shuffle at once, where half of the corpus is less.
ONCE = 64 << 20
#: Text bytes that are hashed at once.
SLICE = 1 << 18


class Bands:
    """Size bands: band j holds pairs whose smaller set has least[j] to least[j+1] - 1 members."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent, self.least = percent, [1]
        growth = (100 / percent) ** 2  # a set is in one band or two, as a rule
        while self.least[-1] <= most:
            self.least.append(max(self.least[-1] + 1, int(self.least[-1] * growth)))

    def difference(self, smaller: int) -> int:
        """The largest symmetric difference of a linked pair."""
        return smaller * (100 - self.percent) // self.percent

    def of(self, n: int) -> list[int]:
        """Bands that a set of n members takes part in: its own, and those that the smaller
        set of a linked pair may be in."""
        first, own = (int(np.searchsorted(self.least, m, side="right")) - 1 for m in (-(-n * self.percent // 100), n))
        return list(range(first, own + 1))

    def words(self, band: int) -> tuple[int, int]:
        """Words of a band's sketch, and its spare: a linked pair differs in at most as
        many words as members, so spare + 1 words are equal. The spare is about what a set of
        random members leaves weak."""
        most = self.difference(self.least[band + 1] - 1)
        share = np.exp(-self.least[band + 1] / (most + 1.0))
        spare = int(1.5 * share * most + 3 * np.sqrt(share * most) + 0.15 * most) if most else 0
        return most + 1 + spare if most else 1, spare


def signatures(members: np.ndarray, bands: Bands, seed: int) -> tuple[np.ndarray, int]:
    """The hashed sketch words of a set in all of its bands. Words of a band whose pairs
    would have to be equal are left out: equal sets are one node. A set with no more than
    ``spare`` weak words leaves these out too: a linked pair has spare + 1 equal words, so
    one that isn't weak, and equal words are weak in both sets or in neither. Also returned is
    the room: how many other words it could leave out by the same reasoning."""
    out, room = [], 1 << 30
    h = mix64(members ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if seed else members
    flips = mix64(h & np.uint64(0xFFFFFFFF))  # names the bit of a word: a linear hash of it
    for band in bands.of(len(members)):
        n, spare = bands.words(band)
        if n == 1:
            continue
        at = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        words = np.zeros(n, np.uint64)
        if (np.diff(at.astype(np.int32)) >= 0).all():  # sorted members without a seed
            heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            words[at[heads]] = np.bitwise_xor.reduceat(flips, heads)
        else:
            np.bitwise_xor.at(words, at, flips)
        name = np.uint64((band << 40) + (seed << 56)) + np.arange(n, dtype=np.uint64)
        hashed = mix64(words + mix64(name))
        weak = np.bincount(at, minlength=n) <= WEAK
        left = spare - int(weak.sum())
        out.append(hashed[~weak] if left >= 0 else hashed)
        room = min(room, max(left, 0))
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), room


def narrow_sketch(members: np.ndarray) -> np.ndarray:
    bits = np.bincount(((members >> np.uint64(8)) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(members: np.ndarray) -> bytes | None:
    """The parities of a set by a power of two of bits, as many as its members at least;
    none where the narrow sketch has as many."""
    width = min(WIDEST, 1 << max(0, len(members) - 1).bit_length())
    if width <= 64 * SKETCH:
        return None
    bits = np.bincount(((members >> np.uint64(8)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """The bits in which two wide sketches differ: at most what their sets differ in. The
    wider one is folded to the width of the other."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


SENT = "nid long, doc_id long, tid binary, key binary, n long, room long, sketch array<long>, wide binary, part long, packed binary, bucket long"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sent_by(texts: DataFrame, width: int, bands: Bands, parts: int) -> DataFrame:
    """Three kinds of rows. For each document its set's key (equal for equal sets), size
    and sketches. For stretches of documents and each part of the hash space the
    words in it, packed, with their documents (relative to nid). And of words that very
    many documents of a stretch share, the documents that weren't packed."""

    def run(batches):
        from pyspark import TaskContext

        nid = start = TaskContext.get().partitionId() << 33
        words, owners, held = [], [], 0
        known: set[bytes] = set()  # equal sets are one node: a task sends the words of its first

        def flush():
            hashes, rows = np.concatenate(words), np.concatenate(owners)
            by = np.argsort(hashes, kind="stable")
            hashes, rows = hashes[by], rows[by]
            head = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            nth = np.arange(len(hashes)) - np.repeat(head, np.diff(np.r_[head, len(hashes)]))
            out = nth >= PACKED
            if out.any():
                yield _sent(nid=rows[out] + start, bucket=hashes[out].view(np.int64))
            hashes, rows = hashes[~out], rows[~out]
            cut, number = ranges(hashes, parts)
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            for i in range(0, len(spans), 16):  # in small batches, as Spark holds whole ones outside its heap
                some = spans[i : i + 16]
                yield _sent(nid=np.full(len(some), start), part=number[i : i + 16], n=np.diff(cut)[i : i + 16], packed=[pack(hashes[a:b], rows[a:b]) for a, b in some])

        for batch in slices(batches, most=SLICE):
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")), width)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            signed = [signatures(s, bands, 0) for s in sets]
            yield _sent(nid=np.arange(nid, nid + len(sets)), doc_id=batch.column(0), tid=batch.column(1), key=keys, n=[len(s) for s in sets], room=[room for _, room in signed], sketch=_lists([narrow_sketch(s) for s in sets]), wide=[wide_sketch(s) for s in sets])
            for i, (found, _) in enumerate(signed):
                if len(found) and keys[i] not in known:
                    known.add(keys[i])
                    words.append(found)
                    owners.append(np.full(len(found), nid - start + i))
                    held += len(found)
            nid += len(sets)
            if held >= ENTRIES:
                yield from flush()
                words, owners, held = [], [], 0
        if held:
            yield from flush()

    return texts.select("doc_id", "tid", "text").mapInArrow(run, SENT)


KINDS = {"nid": pa.int64(), "doc_id": pa.int64(), "tid": pa.binary(), "key": pa.binary(), "n": pa.int64(), "room": pa.int64(), "sketch": pa.list_(pa.int64()), "wide": pa.binary(), "part": pa.int64(), "packed": pa.binary(), "bucket": pa.int64()}


def _sent(**columns) -> pa.RecordBatch:
    n = len(columns["nid"])
    made = [c if isinstance(c := columns.get(name), pa.Array) else pa.nulls(n, kind) if c is None else pa.array(c, kind) for name, kind in KINDS.items()]
    return pa.RecordBatch.from_arrays(made, names=list(KINDS))


def shared_words(table: pa.Table) -> pa.Table:
    """The rows of a part whose word more than one of them has."""
    parts = [(unpack(p, n, 1), start) for p, n, start in zip(table.column("packed").to_pylist(), table.column("n").to_pylist(), table.column("nid").to_pylist(), strict=True)]
    hashes = np.concatenate([p[0] for p, _ in parts])
    nids = np.concatenate([p[1].astype(np.int64) + start for p, start in parts])
    by = np.argsort(hashes, kind="stable")
    hashes, nids = hashes[by], nids[by]
    like = np.zeros(len(hashes), bool)
    like[1:] = hashes[1:] == hashes[:-1]
    like[:-1] |= like[1:]
    found = pa.table({"bucket": pa.array(hashes[like].view(np.int64)), "nid": pa.array(nids[like])})
    del parts, hashes, nids, by, like
    release()  # what follows is Spark's, and the worker waits
    return pa.concat_tables([found.slice(i, 1 << 15) for i in range(0, max(1, found.num_rows), 1 << 15)])


class Join:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        short_batches(docs.sparkSession)
        self.width, self.percent, self.bands = width, percent, Bands(percent)
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("tid"), F.col("text"))
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        self.most = max(ONCE, size // 2)
        # about a shingle for each six bytes, in fewer words by the linked share
        parts = max(1, size * (100 - percent) * 2 // (600 * PART))
        self.sent = materialise(sent_by(self.texts, width, self.bands, parts), "sets")
        self.rows = self.sent.filter("packed is null and bucket is null").select("nid", "doc_id", "tid", "key", "n", "room", "sketch")
        groups = self.rows.filter("n > 0").groupBy("key").agg(F.min("nid").alias("nid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
        self.groups = materialise(groups, "keys")
        self.nodes = self.rows.select("nid", "tid", "n", "sketch")
        self.wide = self.sent.filter("wide is not null").select("nid", "n", "wide")

    # --- pairs

    def close(self, a: str, b: str) -> Column:
        """Neither the sizes nor the narrow sketches forbid a link."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        apart = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (apart * self.percent <= F.least(n, m) * (100 - self.percent))

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that may be linked, by their sketches."""
        lean = self.nodes.select("nid", "n", "sketch")
        x, y = lean.alias("x"), lean.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.nid")).join(y, F.col("b") == F.col("y.nid")).filter(self.close("x", "y")).select("a", "b")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that may be linked, by their wide sketches where both have one. What
        a pair sends is a small part of its texts."""
        a, b = (self.wide.withColumnsRenamed({c: f"{c}_{k}" for c in ("n", "wide")} | {"nid": k}) for k in "ab")
        both = pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
        percent = self.percent

        def run(batches):
            for batch in batches:
                sets = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
                may = [x is None or y is None or bits_apart(x, y) * percent <= min(n, m) * (100 - percent) for n, m, x, y in sets]
                yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

        return both.mapInArrow(run, "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sets are linked, counted on their texts. Each pair sends a text,
        so many pairs go in rounds, of which each has its shuffle to itself."""
        mark = written()
        pairs = materialise(pairs.distinct(), "pairs")
        with batches_of(pairs.sparkSession, 64):  # rows of two sketches
            pairs = materialise(self.near(pairs), "near")
        nids = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
        texts = materialise(self.texts_of(nids).select("nid", "text"), "texts")
        width, percent = self.width, self.percent

        def run(batches):
            for batch in slices(slices(batches, "text_a", SLICE), "text_b", SLICE):
                linked = []
                for s, t in zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width), strict=True):
                    common = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                    linked.append(100 * common >= percent * (len(s) + len(t) - common))
                yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

        ours, others = (texts.select(F.col("nid").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        sent = pairs.join(ours.select("a", F.octet_length("text_a").cast("long").alias("sent")), "a").agg(F.sum("sent")).first()[0] or 0
        rounds, linked = -(-sent // max(1, self.most)) or 1, []
        with batches_of(pairs.sparkSession, 64):  # rows of two texts
            for k in range(rounds):
                part = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k) if rounds > 1 else pairs
                both = part.join(ours, "a").join(others, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
                if rounds == 1:
                    return only(both, "links", mark)
                linked.append(materialise(both, "linked"))
        return only(reduce(DataFrame.unionByName, linked), "links", mark)

    # --- buckets

    def members(self) -> DataFrame:
        """bucket, nid and n (rows of the bucket), of buckets with more than one node. Also
        makes ``needs``: how many buckets of these a node shares at least with any that it is
        linked to, where they are more than one."""
        mark = written()
        packed = self.sent.filter("packed is not null").select("part", "nid", "n", "packed")
        found = packed.groupBy("part").applyInArrow(shared_words, "bucket long, nid long")
        found = found.unionByName(self.sent.filter("bucket is not null").select("bucket", "nid"))
        # copies of one set are one node
        first = self.groups.filter("copies > 1").select("key", F.col("nid").alias("first"))
        copies = self.rows.select("key", F.col("nid")).join(first, "key").filter("nid <> first").select("nid", "first")
        nodes = found.join(copies, "nid", "left").select("bucket", F.coalesce("first", "nid").alias("nid")).distinct()
        nodes = materialise(nodes, "shared")
        # written before the join, so that both of its sides are shuffled and split alike
        several = materialise(nodes.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "several")
        members = materialise(nodes.join(several, "bucket"), "members")
        # Hot words are left out like weak ones: a set with no more of them than its room
        # shares a word that is neither with every set it is linked to.
        hot = members.groupBy("nid").agg(F.count_if(F.col("n") > HOT).alias("hot"), F.count_if(F.col("n") > min(HOT, SMALL)).alias("away"))
        hot = hot.join(self.rows.select("nid", "room"), "nid")
        # a linked node shares room + 1 words, of which those that are away may not be met
        at = written()
        self.needs = materialise(hot.filter(F.col("room") > F.col("away")).select("nid", (F.col("room") + 1 - F.col("away")).alias("need")), "needs")
        light = hot.filter((F.col("hot") > 0) & (F.col("hot") <= F.col("room"))).select("nid", F.lit(True).alias("light"))
        kept = materialise(members.join(light, "nid", "left").filter((F.col("n") <= HOT) | F.col("light").isNull()).select("bucket", "nid"), "kept")
        still = materialise(kept.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "still")
        return only(kept.join(still, "bucket"), "members", mark, but=at)

    def texts_of(self, nids: DataFrame) -> DataFrame:
        """nid, tid and text of nodes. Few of them go to every task that reads texts; of
        more, the texts are shuffled."""
        wanted = materialise(nids.join(self.nodes.select("nid", "tid"), "nid"), "wanted")
        tids = wanted.select("tid").distinct()
        tids = F.broadcast(tids) if wanted.count() <= FEW else tids
        found = self.texts.select("tid", "text").join(tids, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
        return wanted.join(found, "tid")

    def dealt_again(self, members: DataFrame, seed: int) -> DataFrame:
        """The members of large buckets by the words of another sketch as well."""
        width, bands = self.width, self.bands

        def run(batches):
            for batch in slices(batches, most=SLICE):
                sets = shingle_sets(batch.column(1), width)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists([signatures(s, bands, seed)[0] for s in sets])], names=["nid", "words"])

        again = self.texts_of(members.select("nid").distinct()).select("nid", "text").mapInArrow(run, "nid long, words array<long>")
        finer = members.join(again, "nid").select("nid", F.explode("words").alias("word"), "bucket").select("nid", F.xxhash64("bucket", "word").alias("bucket"))
        shared = finer.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        return materialise(finer.join(shared, "bucket"), "members")

    def to_hubs(self, members: DataFrame) -> DataFrame:
        """Each node with the hub of the bucket that is shared most: a hub is the node of a
        bucket whose buckets hold the most rows."""
        shared = members.groupBy("nid").agg(F.sum("n").alias("shared"))
        rated = members.join(shared, "nid")
        hubs = rated.groupBy("bucket").agg(F.max(F.struct("shared", (-F.col("nid")).alias("at"))).alias("hub"))
        near = members.join(hubs, "bucket").filter(F.col("nid") != -F.col("hub.at"))
        best = near.groupBy("nid").agg(F.max("hub").alias("hub"))
        return best.select(F.least("nid", -F.col("hub.at")).alias("a"), F.greatest("nid", -F.col("hub.at")).alias("b"))

    def apart(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the buckets that hold more than one component, with it and the rows left."""
        rows = members.select("bucket", "nid").join(labels, F.col("nid") == F.col("node"), "left").select("bucket", "nid", F.coalesce("component", "nid").alias("component"))
        mixed = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket", "n")
        return materialise(rows.join(mixed, "bucket"), "apart")

    def across(self, rows: DataFrame, needs: DataFrame | None = None) -> DataFrame:
        """Pairs of different components of one bucket that their sketches allow, and that
        share as many buckets as both need."""
        nodes = self.nodes.select("nid", F.col("n").alias("size"), "sketch")
        nodes = nodes.withColumn("need", F.lit(1)) if needs is None else nodes.join(needs, "nid", "left").withColumn("need", F.coalesce("need", F.lit(1)))
        full = rows.join(nodes, "nid").select("bucket", "nid", "component", F.col("size").alias("n"), "sketch", "need")
        x, y = full.alias("x"), full.alias("y")
        met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")) & self.close("x", "y"))
        met = met.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b"), F.greatest("x.need", "y.need").alias("need"))
        return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select("a", "b")

    def links(self, rounds: int = 2) -> DataFrame:
        """Verified links that connect what all links connect."""
        members = self.members()
        found = self.verified(self.sketched(self.to_hubs(members)))
        for seed in range(1, rounds + 1):
            rows = self.apart(members, components(found))
            last = seed == rounds
            met = rows if last else rows.filter(F.col("n") <= SMALL)
            more = self.verified(self.across(met, self.needs if seed == 1 else None))
            found = found.unionByName(more)
            large = rows.filter(F.col("n") > SMALL)
            if last or large.isEmpty():
                return found
            members = self.dealt_again(large.select("bucket", "nid"), seed)
            found = found.unionByName(self.verified(self.sketched(self.to_hubs(members))))
        return found

    def result(self) -> DataFrame:
        labels = components(self.links())
        named = self.groups.join(labels, F.col("nid") == F.col("node"), "left").select("key", "least", F.coalesce("component", "nid").alias("component"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        by_key = named.join(least, "component").select("key", "component_id")
        rows = self.rows.select("doc_id", "key", F.col("n").alias("n_shingles"))
        return rows.join(by_key, "key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


    def survivors(self) -> DataFrame:
        labels = components(self.links())
        row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
        sets = self.rows.filter("n > 0").groupBy("key").agg(F.min("nid").alias("nid"), F.min(row).alias("row"))
        named = sets.join(labels, F.col("nid") == F.col("node"), "left").select("row", F.coalesce("component", "nid").alias("component"))
        return named.groupBy("component").agg(F.min("row").alias("row")).select("row.doc_id", "row.tid")


def surviving_rows(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id and tid (MD5 of the text, binary) of one row of each component of the rows
    with shingles: of its smallest doc_id, and the least tid of that; null ids come last."""
    mark = written()
    return only(Join(docs, width, percent).survivors(), "survivors", mark)


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id for every row: the smallest doc_id that links
    reach. Documents link when their sets of ``width``-word shingles have a Jaccard
    similarity of percent / 100 at least. Null and empty texts have no shingles and their
    own doc_id; equal rows are copies. Shingles are compared by 64-bit hashes."""
    mark = written()
    return only(Join(docs, width, percent).result(), "components", mark)
