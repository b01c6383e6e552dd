"""Word n-gram sets of texts, hashed to 64 bits, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillon.llm.common import ASCII_SPACE, cache_of, mix64, text_bytes

#: A-Z to a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(ASCII_SPACE)] = True
#: A random odd base with base % 8 == 3, so that no short power of it is near 1 modulo 2^64.
BASE = 0x9E3779B97F4A7C15 & ~7 | 3
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

#: Powers that a worker keeps: 2 MB for each base.
KEPT = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64: n of them. Up to ``KEPT`` are kept for the next call."""
    kept = cache_of("hashes")
    known = kept.get(base)
    if known is None or len(known) < n:
        known = np.full(1 << max(16, int(n - 1).bit_length()) if n <= KEPT else n, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= KEPT:
            kept[base] = known
    return known[:n]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of other than ASCII white space, A-Z lower-cased) of a
    text column, and the number of the row that each stands in."""
    raw, offsets = text_bytes(column)
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = ~IS_SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    before[heads] = False  # words never cross rows
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[LOWER[raw]] * powers(BASE, n), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * powers(BASE_INVERSE, n)[starts])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, rows


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row: of ``width`` words in a row; with
    fewer words, the whole sequence as one; none without words (or text)."""
    hashes, rows = words(column)
    count = np.bincount(rows, minlength=len(column)) if len(rows) else np.zeros(len(column), np.int64)
    ends = np.cumsum(count)
    combined = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        combined += hashes[k : k + len(combined)] * PLACE[k]
    combined = mix64(combined)
    out = []
    for n, end in zip(count.tolist(), ends.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(combined[end - n : end - width + 1]))
        elif n:
            short = hashes[end - n : end] * PLACE[width + 1 : width + 1 + n]
            out.append(mix64(np.array([short.sum(dtype=np.uint64) ^ np.uint64(n)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out
