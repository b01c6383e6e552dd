"""Removal of byte strings that start more than once, by column-wise construction.

Documents are far too many for one suffix array, so the work is dealt first. Of every
window of ``WINDOW`` symbols the least of its grams (by a hash, ties to the right) is an anchor: equal windows have equal anchors at equal places, so any two equal
windows meet under one anchor hash, and an anchor needs only the symbols around it that a
window may reach, its context. Equal contexts are counted by hash; different contexts of one
anchor are collected documents of a small multi-document index. It is built column by
column: each round inserts one symbol for each document in front of the suffixes so far,
which permutes them stably by the new symbol (the Burrows-Wheeler step) and updates the
common prefixes from their minima. A suffix whose common prefix with a neighbour reaches the
window length starts a repeated window. Rounds read and write their columns front to back
only.

An index has ``many`` documents at most. An anchor with more contexts is dealt again, in
``PARTS`` parts of its offsets, by what the windows of a part must share; where more than
``many`` contexts share even that, the few windows of that part are counted by hash,
relationally, however many there are.

Symbols are bytes (strings of ``WINDOW`` are removed) and, in the same passes, words
(passages of ``PASSAGE`` words are counted, not removed).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise, mix64, only, short_batches, slices, text_bytes, written
from quillon.llm.shingles import BASE, BASE_INVERSE, BYTE_VALUES, powers, words

WINDOW = 400
#: Words of a passage that is counted: more than 50.
PASSAGE = 51
#: Contexts of an anchor beyond which it is dealt again, and in how many parts.
MANY, PARTS = 4096, 8
#: Contexts that are compared at once: whole indexes, of at most ``many`` each.
TOGETHER = 8192
BYTES, WORDS = 0, 1
#: Sets the anchors of words apart from those of bytes.
SALT = [np.uint64(0), np.uint64(0x5851F42D4C957F2D)]
ANCHORS = "nid long, tid binary, n_words long, anchors array<long>, contexts array<long>, places array<long>"


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` keys in a row."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def gram_of(kind: int, window: int) -> int:
    """Symbols of an anchor. Shorter ones make fewer anchors, and more that meet by chance."""
    return window // 2 if kind == BYTES else max(1, window // 3)


def anchors_of(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in ``values``, a hash for each symbol of all rows), hashes and context hashes
    of the anchors of all rows."""
    n = len(values)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    inverse = powers(BASE_INVERSE, n + 1)
    hashes = mix64((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])
    at = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << 32) - 1)
    least = sliding_least((hashes & ~low) | (low - at), window - gram + 1)
    picked = (low - (least & low)).astype(np.int64)
    # windows that lie within one row
    inside = np.zeros(n + 1, np.int64)
    lengths = np.diff(offsets)
    long_enough = lengths >= window
    np.add.at(inside, offsets[:-1][long_enough], 1)
    np.add.at(inside, offsets[1:][long_enough] - window + 1, -1)
    picked = picked[np.cumsum(inside)[: len(picked)] > 0]
    if not len(picked):
        return none, none.astype(np.uint64), none.astype(np.uint64)
    places = picked[np.r_[True, picked[1:] != picked[:-1]]]
    row = np.searchsorted(offsets, places, side="right") - 1
    lo = np.maximum(places - (window - gram), offsets[row])
    hi = np.minimum(places + window, offsets[row + 1])
    content = (sums[hi] - sums[lo]) * inverse[lo]
    shape = ((places - lo) << 32 | (hi - places)).astype(np.uint64)
    return places, hashes[places], mix64(content ^ mix64(shape))


def _int_lists(flat: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat, kind))


def anchor_rows(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """The anchors of each text, for the window of each kind of symbol (0: none). ``places``
    holds the place of an anchor, doubled, and 1 more for words."""

    def run(batches):
        from pyspark import TaskContext

        nid = TaskContext.get().partitionId() << 33
        for batch in slices(batches, most=1 << 18):
            rows, found, n_words = batch.num_rows, [], np.zeros(batch.num_rows, np.int64)
            if sizes[BYTES]:
                raw, offsets = text_bytes(batch.column(1))
                found.append((BYTES, BYTE_VALUES[raw], offsets))
            if sizes[WORDS]:
                hashes, row = words(batch.column(1))
                found.append((WORDS, hashes, np.searchsorted(row, np.arange(rows + 1))))
                n_words = np.diff(found[-1][2])
            at = []
            for kind, values, offsets in found:
                places, hashes, contexts = anchors_of(values, offsets, sizes[kind], gram_of(kind, sizes[kind]))
                row = np.searchsorted(offsets, places, side="right") - 1
                at.append((row, hashes ^ SALT[kind], contexts, (places - offsets[row]) * 2 + kind))
            row, hashes, contexts, places = (np.concatenate(x) for x in zip(*at, strict=True))
            by = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[by], np.arange(rows + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(nid, nid + rows)), batch.column(0), pa.array(n_words, pa.int64()), _int_lists(hashes[by].view(np.int64), cuts, pa.int64()), _int_lists(contexts[by].view(np.int64), cuts, pa.int64()), _int_lists(places[by], cuts, pa.int64())],
                names=["nid", "tid", "n_words", "anchors", "contexts", "places"],
            )
            nid += rows

    return texts.select("tid", "text").mapInArrow(run, ANCHORS)


def repeated_starts(columns: np.ndarray, group: np.ndarray, window: int, end: int) -> np.ndarray:
    """For documents of equal width (symbols below ``end``, and ``end`` beyond a text's edge), in groups:
    a mask of the columns at which a window starts that another document of the group
    has at the same column."""
    m, width = columns.shape
    starts = np.zeros((m, width - window + 1), bool)
    order = np.argsort(group, kind="stable")
    g = group[order]
    together = np.zeros(m, bool)  # with the one before: the same group
    together[1:] = g[1:] == g[:-1]
    number = np.cumsum(~together) - 1
    common = np.zeros(m, np.int32)  # prefix shared with the one before
    for j in range(width - 1, -1, -1):
        symbol = columns[order, j].astype(np.int64)
        step = np.argsort(number * (end + 1) + symbol, kind="stable")
        symbol = symbol[step]
        same = np.zeros(m, bool)
        same[1:] = together[1:] & (symbol[1:] == symbol[:-1]) & (symbol[1:] != end)
        fresh = np.zeros(m, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            # the least common prefix between the two places in the order before
            pairs = np.empty(2 * len(at), np.int64)
            pairs[::2], pairs[1::2] = step[at - 1] + 1, step[at] + 1
            fresh[at] = np.minimum.reduceat(np.r_[common, 0], pairs)[::2] + 1
        np.minimum(fresh, window, out=fresh)
        common, order = fresh, order[step]
        if j <= width - window:
            full = common >= window
            hit = full.copy()
            hit[:-1] |= full[1:]
            starts[order[hit], j] = True
    return starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of a mask."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    change = np.diff(wide, axis=1)
    row, first = np.nonzero(change == 1)
    _, after = np.nonzero(change == -1)
    return row, first, after - 1


def repeated_spans(docs: DataFrame, sizes: list[int], many: int) -> DataFrame:
    """tid, spans (coded kind, lo and hi: the symbols of a text that repeated windows cover;
    spans may overlap) and n_words, for each text with any."""
    reaches = [size - gram_of(kind, size) for kind, size in enumerate(sizes)]
    least = min(size if kind == BYTES else 2 * size - 1 for kind, size in enumerate(sizes) if size)
    texts = docs.select(F.unhex(F.md5("text")).alias("tid"), "text").filter(F.octet_length("text") >= least)
    rows = materialise(anchor_rows(texts, sizes), "anchors")
    every = rows.select("nid", F.explode(F.arrays_zip("anchors", "contexts", "places")).alias("x")).select(F.col("x.anchors").alias("anchor"), F.col("x.contexts").alias("context"), "nid", F.col("x.places").alias("place"))
    # counts are written before they are joined, so that both sides are shuffled and split alike
    shared = materialise(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "shared")
    met = materialise(every.join(shared, "anchor"), "met")
    alike = materialise(met.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("nid", "place")).alias("first")), "alike")
    name = rows.select("nid", "tid")

    # equal contexts: every window that holds the anchor repeats
    kind, at = F.col("place") % 2, F.floor(F.col("place") / 2)
    reach, size = (F.when(kind == WORDS, x[WORDS]).otherwise(x[BYTES]) for x in (reaches, sizes))
    full = met.join(alike.filter("n > 1").select("anchor", "context"), ["anchor", "context"]).select("nid", coded(kind, F.greatest(F.lit(0), at - reach), at + size).alias("span"))
    full = full.groupBy("nid").agg(F.collect_list("span").alias("spans")).join(rows.select("nid", "tid", "n_words"), "nid")
    full = full.groupBy("tid").agg(F.first("spans").alias("spans"), F.first("n_words").alias("n_words"))  # of equal texts they are equal

    # different contexts: the symbols of each are compared
    varied = materialise(alike.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1"), "varied")
    wanted = alike.join(varied, "anchor").select("anchor", "contexts", F.col("first.nid").alias("nid"), F.col("first.place").alias("place"), (F.col("n") == 1).alias("open"))
    wanted = wanted.join(name, "nid").groupBy("tid").agg(F.collect_list(F.struct("anchor", "contexts", "place", "open")).alias("wanted"))
    whole = texts.join(wanted.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    cut = whole.join(wanted, "tid").select("tid", "text", "wanted").mapInArrow(lambda it: _contexts(it, sizes, many), f"{PIECE}, place long, open boolean, symbols binary")
    cut = materialise(cut, "contexts")
    # a part with one row has nothing to be compared with; parts stay whole within a task
    parts = materialise(cut.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1"), "parts")
    small, large = parts.filter(F.col("n") <= many).select("part"), parts.filter(F.col("n") > many).select("part")
    dealt = cut.join(small, "part").repartition(F.col("part")).sortWithinPartitions("part").select(cut.columns)
    part = dealt.mapInArrow(lambda it: _compare(it, sizes), SPAN)
    if large.isEmpty():
        return _together(full, part)
    # each window of a large part by its hash
    single = cut.join(large, "part").select(cut.columns).mapInArrow(lambda it: _windows(it, sizes), f"window binary, open boolean, {SPAN}")
    single = materialise(single, "windows")
    where = F.struct("tid", "lo")  # a window may come from two parts or anchors
    again = materialise(single.groupBy("window").agg(F.min(where).alias("first"), F.max(where).alias("last")).filter("first <> last").select("window"), "again")
    return _together(full, part.unionByName(single.filter("open").join(again, "window").select("tid", "kind", "lo", "hi")))


def coded(kind, lo, hi):
    """A span as one long."""
    return (kind.cast("long") * (1 << 62) + lo.cast("long") * (1 << 31) + hi.cast("long")).cast("long")


def _together(full: DataFrame, part: DataFrame) -> DataFrame:
    """The spans of each text: from equal contexts, and those that were found one by one."""
    single = part.groupBy("tid").agg(F.collect_set(coded(F.col("kind"), F.col("lo"), F.col("hi"))).alias("spans")).withColumn("n_words", F.lit(None).cast("long"))
    return full.unionByName(single).groupBy("tid").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("n_words").alias("n_words"))


PIECE = "part long, kind int, lo int, tid binary"
SPAN = "tid binary, kind int, lo int, hi int"


def _contexts(batches, sizes: list[int], many: int):
    """The symbols around each wanted anchor: of the whole context, or for anchors with more
    than ``many`` of them of its parts, by what a part's windows share."""
    for batch in slices(batches, "text", 1 << 20):
        out = []
        for row, (tid, text, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            symbols = [np.frombuffer(text.encode(), np.uint8), None]
            if any(x["place"] % 2 for x in wanted):
                symbols[WORDS] = words(batch.column(1).slice(row, 1))[0]
            for x in wanted:
                p, kind = x["place"] // 2, x["place"] % 2
                raw, window = symbols[kind], sizes[kind]
                reach = window - gram_of(kind, window)
                if x["contexts"] <= many:
                    out.append((x["anchor"], kind, -reach, tid, p, x["open"], _piece(raw, p - reach, p + window)))
                    continue
                for i in range(PARTS):
                    a, b = i * reach // PARTS, (i + 1) * reach // PARTS
                    if p - a < 0 or p - b + window > len(raw):
                        continue
                    common = raw[p - a : p - b + window].tobytes()
                    key = int.from_bytes(hashlib.blake2b(common, digest_size=8, key=b"%d:%d" % (x["anchor"], i)).digest(), "little", signed=True)
                    out.append((key, kind, -b, tid, p, x["open"], _piece(raw, p - b, p - a + window)))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["part", "kind", "lo", "tid", "place", "open", "symbols"])


def _piece(symbols: np.ndarray, lo: int, hi: int) -> bytes:
    """Symbols and, where the text doesn't reach, a mark: the first two bytes give the
    symbols missing in front."""
    return max(0, -lo).to_bytes(2, "big") + symbols[max(0, lo) : hi].tobytes()


def _symbols(piece: bytes, kind: int) -> tuple[int, np.ndarray]:
    return int.from_bytes(piece[:2], "big"), np.frombuffer(piece[2:], np.uint64 if kind == WORDS else np.uint8)


def _compare(batches, sizes: list[int], most: int = TOGETHER):
    """Builds the indexes of whole parts, about ``most`` documents at a time."""

    def done(rows: list[tuple], kind: int):
        part, _, lo, tid, place, open_, pieces = zip(*rows, strict=True)
        window = sizes[kind]
        read = [_symbols(x, kind) for x in pieces]
        flat = np.concatenate([x for _, x in read])
        if kind == WORDS:  # numbers of the words that occur
            known, flat = np.unique(flat, return_inverse=True)
            end = len(known)
        else:
            end = 256
        columns, at = np.full((len(rows), 2 * window - gram_of(kind, window)), end, np.int16 if end < 1 << 15 else np.int32), 0
        for i, (front, x) in enumerate(read):
            columns[i, front : front + len(x)] = flat[at : at + len(x)]
            at += len(x)
        _, group = np.unique(np.array(part), return_inverse=True)
        starts = repeated_starts(columns, group, window, end) & np.array(open_)[:, None]
        row, first, last = runs(starts)
        base = np.array(place)[row] + np.array(lo)[row]
        return pa.RecordBatch.from_arrays([pa.array([tid[i] for i in row.tolist()], pa.binary()), pa.array([kind] * len(row), pa.int32()), pa.array(base + first, pa.int32()), pa.array(base + last + window, pa.int32())], names=["tid", "kind", "lo", "hi"])

    held: list[list[tuple]] = [[], []]
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            kind = row[1]
            if len(held[kind]) >= most and row[0] != held[kind][-1][0]:
                yield done(held[kind], kind)
                held[kind] = []
            held[kind].append(row)
    for kind in (BYTES, WORDS):
        if held[kind]:
            yield done(held[kind], kind)


def _windows(batches, sizes: list[int]):
    """Every window of the pieces: its hash, and where it is."""
    for batch in batches:
        out = []
        for _, kind, lo, tid, place, open_, piece in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            front, symbols = _symbols(piece, kind)
            for i in range(len(symbols) - sizes[kind] + 1):
                start = place + lo + front + i
                out.append((hashlib.blake2b(symbols[i : i + sizes[kind]].tobytes(), digest_size=16, key=b"%d" % kind).digest(), open_, tid, kind, start, start + sizes[kind]))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["window", "open", "tid", "kind", "lo", "hi"])


def dedup(docs: DataFrame, window: int = WINDOW, passage: int = PASSAGE, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, n_passages and
    kept (the remaining bytes) for every row. Bytes of a ``window`` that also starts anywhere
    else are removed. Words (lower-cased, between ASCII white space) of ``passage`` words in a
    row that also start anywhere else are counted, with their maximal runs, and stay;
    ``passage`` 0 leaves this out, and both are 0. Null text counts as empty. Repeated rows
    repeat each other."""
    short_batches(docs.sparkSession)
    sizes = [window, passage]
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    mark = written()
    spans = only(repeated_spans(texts, sizes, many), "spans", mark)
    rows = texts.withColumn("tid", F.unhex(F.md5("text"))).join(spans, "tid", "left").select("doc_id", "text", "spans", "n_words")

    def covered(spans: np.ndarray, kind: int, n: int) -> tuple[np.ndarray, int]:
        if not n:
            return np.zeros(0, bool), 0
        mine = spans[spans >> 62 == kind]
        lo, hi = mine >> 31 & (1 << 31) - 1, mine & (1 << 31) - 1
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, lo, 1)
        np.add.at(change, np.minimum(hi, n), -1)
        gone = np.cumsum(change)[:-1] > 0
        return gone, int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())

    def run(batches):
        for batch in slices(batches):
            out = []
            lists = batch.column(2)
            cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, (doc, text, n_words) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)):
                raw = np.frombuffer(text.encode(), np.uint8)
                found = flat[cuts[i] : cuts[i + 1]] if lists[i].is_valid else flat[:0]
                gone, heads = covered(found, BYTES, len(raw))
                # texts with passages that were only found one by one end no span beyond their words
                ends = found[found >> 62 == WORDS] & (1 << 31) - 1
                in_passage, passages = covered(found, WORDS, int(ends.max(initial=0)) if n_words is None else min(n_words, int(ends.max(initial=0))))
                kept = raw[~gone].tobytes()
                out.append((doc, len(raw), int(gone.sum()), heads, hashlib.sha256(kept).hexdigest(), int(in_passage.sum()), passages, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long, kept binary")
