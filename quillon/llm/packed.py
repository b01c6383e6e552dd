"""Packed columns of hashes for shuffles: many entries in one binary value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CODEC = "zstd"


def pack(hashes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending 64-bit hashes as differences, then 32-bit columns, each by byte place, so
    that what is small or alike compresses."""
    planes = [np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()]
    planes += [np.ascontiguousarray(c.astype(np.int64).astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec=CODEC, asbytes=True)


def unpack(blob: bytes, n: int, columns: int) -> list[np.ndarray]:
    """The hashes (uint64) and the other columns (int32)."""
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=(8 + 4 * columns) * n, codec=CODEC, asbytes=True), np.uint8)
    part = lambda at, width, kind: np.ascontiguousarray(raw[at * n : (at + width) * n].reshape(width, n).T).view(kind).ravel()
    return [np.cumsum(part(0, 8, np.uint64), dtype=np.uint64), *(part(8 + 4 * i, 4, np.int32) for i in range(columns))]


def ranges(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes by equal ranges of the hash space: where each range that occurs
    starts (and the end), and its number."""
    number = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else np.zeros(1, np.int64)
    return cuts, number[cuts[:-1]]
