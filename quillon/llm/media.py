"""Media columns: MPEG audio.

A media column holds a complete MPEG-2 Layer III stream per row. ``encode`` stores bytes
losslessly in the ancillary part of silent frames (one byte for each of a frame's 576
samples); ``parse`` reads any Layer I-III stream: it skips ID3v2/ID3v1/APE tags,
resynchronises on frame headers, verifies the CRC-16 of protected frames (Layers I and III;
what it covers in Layer II depends on the frame's allocations), reads Xing, Info and VBRI
tables, and gives exact durations and the byte offset of every frame. Free-format streams,
which give no frame size, are skipped as junk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import short_batches, slices

# Fixed values of the MPEG audio standards: bit rates in kbit/s by (MPEG-1?, layer), and
# sample rates in Hz by version.
BIT_RATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
SAMPLE_RATES = {"1": [44100, 48000, 32000], "2": [22050, 24000, 16000], "2.5": [11025, 12000, 8000]}

#: Samples of a frame that ``encode`` writes, and so the payload bytes in it.
UNIT = 576
#: MPEG-2, Layer III, protected by a CRC; 144 kbit/s at 16 kHz, mono: 72 * 144000 / 16000 bytes a frame.
HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC4])
FRAME = 648
SIDE = 9
BODY = 4 + 2 + SIDE


def _crc_table() -> np.ndarray:
    """Of the CRC-16 with polynomial 0x8005, most significant bit first."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ 0x8005, table << 1) & 0xFFFF
    return table.astype(np.uint16)


CRC_TABLE = _crc_table()


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    crc = start
    for b in data:
        crc = ((crc << 8) & 0xFFFF) ^ int(CRC_TABLE[(crc >> 8) ^ b])
    return crc


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bit_rate: int
    sample_rate: int
    padding: int
    channels: int
    size: int
    samples: int
    joint: int = 0  # mode extension of joint stereo, from 1

    @property
    def side(self) -> int:
        """Bytes that the checksum covers after it: Layer III side information, Layer I bit
        allocations (four bits for a subband and channel, shared from a bound on)."""
        if self.layer == 2:
            return 0
        if self.layer == 1:
            return 16 if self.channels == 1 else (32 + 4 * self.joint) // 2 if self.joint else 32
        if self.version == "1":
            return 17 if self.channels == 1 else 32
        return 9 if self.channels == 1 else 17


def read_header(data: bytes, at: int) -> Header | None:
    """The frame header at ``at``, or None. Free-format and reserved values are none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version = {0: "2.5", 2: "2", 3: "1"}.get((b1 >> 3) & 3)
    layer = {1: 3, 2: 2, 3: 1}.get((b1 >> 1) & 3)
    rate, freq = b2 >> 4, (b2 >> 2) & 3
    if version is None or layer is None or rate in (0, 15) or freq == 3 or b3 & 3 == 2:
        return None
    kbps, hertz, padding = BIT_RATES[version == "1", layer][rate], SAMPLE_RATES[version][freq], (b2 >> 1) & 1
    if layer == 1:
        size, samples = (12 * kbps * 1000 // hertz + padding) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == "1" else 576
        size = samples // 8 * kbps * 1000 // hertz + padding
    return Header(version, layer, not b1 & 1, kbps * 1000, hertz, padding, 1 if b3 >> 6 == 3 else 2, size, samples, (b3 >> 4 & 3) + 1 if b3 >> 6 == 1 else 0)


@dataclass
class Stream:
    """What ``parse`` finds. offsets: of each audio frame in the stored bytes."""

    offsets: np.ndarray
    duration: Fraction = Fraction(0)
    samples: int = 0
    sample_rate: int = 0
    version: str = ""
    layer: int = 0
    tags: list[str] = field(default_factory=list)
    vbr: str = ""
    vbr_frames: int = -1
    vbr_bytes: int = -1
    toc: list[int] = field(default_factory=list)
    crc_checked: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    uniform: Header | None = None


def _tag_at(data: bytes, at: int) -> tuple[str, int] | None:
    if data[at : at + 3] == b"ID3" and at + 10 <= len(data) and all(x < 128 for x in data[at + 6 : at + 10]):
        a, b, c, d = data[at + 6 : at + 10]
        return f"id3v2.{data[at + 3]}", 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 16 else 0)
    if data[at : at + 3] == b"TAG" and len(data) - at == 128:
        return "id3v1", 128
    if data[at : at + 8] == b"APETAGEX" and at + 32 <= len(data):
        size, _, flags = struct.unpack_from("<III", data, at + 12)
        return "ape", size + (32 if flags >> 31 and flags >> 29 & 1 else 0)
    return None


def _table(data: bytes, at: int, header: Header) -> tuple[str, int, int, list[int]] | None:
    """The Xing, Info or VBRI table of a first frame: kind, frames, bytes, seek table."""
    spot = at + 4 + 2 * header.protected + header.side
    kind = data[spot : spot + 4]
    if kind in (b"Xing", b"Info"):
        flags, spot = int.from_bytes(data[spot + 4 : spot + 8], "big"), spot + 8
        frames = size = -1
        toc: list[int] = []
        if flags & 1:
            frames, spot = int.from_bytes(data[spot : spot + 4], "big"), spot + 4
        if flags & 2:
            size, spot = int.from_bytes(data[spot : spot + 4], "big"), spot + 4
        if flags & 4:
            toc = list(data[spot : spot + 100])
        return kind.decode(), frames, size, toc
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        size, frames, entries, scale, width, _ = struct.unpack_from(">IIHHHH", data, at + 46)
        return "VBRI", frames, size, [int.from_bytes(data[at + 62 + i * width : at + 62 + (i + 1) * width], "big") * scale for i in range(entries)]
    return None


def _run_of_equal_frames(data: bytes, at: int, header: Header) -> int:
    """How many frames with exactly this header stand one after another from ``at``."""
    rows, own, n, step = (len(data) - at) // header.size, np.frombuffer(data, np.uint8, 4, at), 0, 8
    while n < rows:  # looks at no more than twice what it finds
        step = min(step, rows - n)
        heads = np.frombuffer(data, np.uint8, step * header.size, at + n * header.size).reshape(step, header.size)[:, :4]
        same = (heads == own).all(axis=1)
        if not same.all():
            return n + int(np.argmin(same))
        n, step = n + step, 2 * step
    return n


def parse(data: bytes) -> Stream:
    """Reads a stream from its bytes alone. Broken headers and junk are skipped up to the
    next header that another header (or the end) confirms; frames cut off at the end are
    left out. Empty input: no frames, duration 0."""
    ahead = dict.fromkeys((b"\xff", b"TAG", b"APETAGEX", b"ID3"), -1)  # the next places of what may follow junk

    def next_place(at: int) -> int:
        for mark, place in ahead.items():
            if place <= at:
                found = data.find(mark, at + 1)
                ahead[mark] = len(data) if found < 0 else found
        return max(at + 1, min(ahead.values()))

    out, at, runs, steady, first, last = Stream(np.empty(0, np.int64)), 0, [], True, True, None
    seconds = Fraction(0)
    while at < len(data):
        tag = _tag_at(data, at)
        if tag:
            out.tags.append(tag[0])
            at += max(tag[1], 1)
            continue
        header = read_header(data, at)
        fits = header is not None and at + header.size <= len(data)
        after = at + header.size if fits else 0
        kind = header and (header.version, header.layer, header.sample_rate)
        if fits and not (steady and kind == last) and after < len(data) and not (read_header(data, after) or _tag_at(data, after)):
            fits = False  # a header by chance: where the stream breaks or changes a second one must follow
        if not fits:
            if steady:
                out.resyncs += 1
            steady, nxt = False, next_place(at)
            out.skipped += nxt - at
            at = nxt
            continue
        steady, last = True, kind
        if first:
            first = False
            out.version, out.layer, out.sample_rate = header.version, header.layer, header.sample_rate
            found = _table(data, at, header) if header.layer == 3 else None
            if found:
                out.vbr, out.vbr_frames, out.vbr_bytes, out.toc = found
                at = after
                continue
        n = _run_of_equal_frames(data, at, header)
        runs.append(at + header.size * np.arange(n, dtype=np.int64))
        out.uniform = header if len(runs) == 1 else None
        out.samples += n * header.samples
        seconds += Fraction(n * header.samples, header.sample_rate)
        if header.protected and header.layer != 2 and header.size >= 6 + header.side:
            frames = np.frombuffer(data, np.uint8, n * header.size, at).reshape(n, header.size)
            crc = np.full(n, 0xFFFF, np.uint16)
            for k in [2, 3, *range(6, 6 + header.side)]:
                crc = (crc << np.uint16(8)) ^ CRC_TABLE[(crc >> np.uint16(8)) ^ frames[:, k]]
            stored = frames[:, 4].astype(np.uint16) << np.uint16(8) | frames[:, 5]
            out.crc_checked += n
            out.crc_bad += int((crc != stored).sum())
        at += n * header.size
    out.duration = seconds
    if runs:
        out.offsets = np.concatenate(runs)
    return out


def pad(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of ``UNIT``."""
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT)


def encode(payload: bytes) -> bytes:
    """A stream that holds ``payload`` (a positive multiple of ``UNIT``): an ID3v2.4 tag
    with the payload's length, an Info frame with counts and a seek table, then a silent
    frame for each 576 payload bytes."""
    n, rest = divmod(len(payload), UNIT)
    if rest or not n:
        raise ValueError(f"a payload is a positive multiple of {UNIT} bytes, not {len(payload)}")
    value = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + _syncsafe(len(value)) + b"\x00\x00" + value
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame
    checksum = crc16(HEADER[2:] + bytes(SIDE)).to_bytes(2, "big")
    head = HEADER + checksum + bytes(SIDE)
    total = (n + 1) * FRAME
    toc = bytes(min(255, 256 * (FRAME + (i * n // 100) * FRAME) // total) for i in range(100))
    info = (head + b"Info" + struct.pack(">III", 7, n, total) + toc).ljust(FRAME, b"\x00")
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :BODY] = np.frombuffer(head, np.uint8)
    frames[:, BODY : BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    return tag + info + frames.tobytes()


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def read_payload(media: bytes, stream: Stream) -> bytes:
    """The bytes that ``encode`` stored, taken from the frames that ``parse`` found."""
    if stream.uniform and len(stream.offsets):
        n, at = len(stream.offsets), int(stream.offsets[0])
        return np.frombuffer(media, np.uint8, n * FRAME, at).reshape(n, FRAME)[:, BODY : BODY + UNIT].tobytes()
    return b"".join(media[o + BODY : o + BODY + UNIT] for o in stream.offsets.tolist())


def seek(stream: Stream, sample: int) -> int:
    """Offset of the frame that holds a sample, for a stream of one frame length."""
    return int(stream.offsets[sample // (stream.samples // len(stream.offsets))])


def encode_column(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with a binary column of MPEG streams that hold the UTF-8 bytes of ``text``,
    padded (null: as empty). A column named as ``media`` is replaced."""
    short_batches(df.sparkSession)
    kept = df.drop(media)
    schema = T.StructType([*kept.schema.fields, T.StructField(media, T.BinaryType())])
    column = text

    def run(batches):
        for batch in slices(batches, column):
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            made = pa.array([encode(pad((t or "").encode())) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, media])

    return kept.mapInArrow(run, schema)



def features(payload: bytes, stream: Stream) -> str:
    """Of the samples and the stream: exact duration, frames, seek points, and the mean,
    the mean absolute step and the zero crossings (about 128) of the 8-bit samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16)
    step = int(np.abs(np.diff(x)).sum())
    crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
    points = [seek(stream, stream.samples * i // 4) for i in range(4)] if len(stream.offsets) else []
    d = stream.duration
    return f"mpeg{stream.version}-l{stream.layer};rate={stream.sample_rate};frames={len(stream.offsets)};seconds={d.numerator}/{d.denominator};seek={'/'.join(map(str, points))};crc={stream.crc_checked - stream.crc_bad}/{stream.crc_checked};sum={int(x.sum())};step={step};cross={crossings}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """Digests of a media column's streams: what was stored, read back from the frames.
    Needs doc_id and n_bytes beside ``media``, and keeps both as they are. A null stream
    counts as an empty one: no payload, and the digests of no bytes."""
    short_batches(df.sparkSession)
    narrow = df.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), F.col(media).alias("media"))

    def run(batches):
        for batch in slices(batches, "media"):
            rows = []
            for doc, n, stored in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                stored = stored or b""
                stream = parse(stored)
                payload = read_payload(stored, stream)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload, stream)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    return narrow.mapInArrow(run, DIGEST)


NAMES = [x.split()[0] for x in DIGEST.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in DIGEST.split(", ")]


def parse_column(df: DataFrame, media: str = "media") -> DataFrame:
    """doc_id and what ``parse`` reads from each stream of ``media``: the frame seek
    offsets, exact durations (microseconds, rounded down), tags and checksum counts.
    Null media: nulls."""
    narrow = df.select("doc_id", F.col(media).alias("media"))
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, duration_us long, n_frames long, sample_rate int, tags array<string>, vbr string, crc_checked long, crc_bad long, resyncs long, frame_offsets array<long>"

    def run(batches):
        for batch in slices(batches, "media"):
            found = [None if x is None else parse(x) for x in batch.column(1).to_pylist()]
            get = lambda f: [None if s is None else f(s) for s in found]
            columns = [
                batch.column(0),
                pa.array(get(lambda s: s.duration.numerator * 1_000_000 // s.duration.denominator), pa.int64()),
                pa.array(get(lambda s: len(s.offsets)), pa.int64()),
                pa.array(get(lambda s: s.sample_rate), pa.int32()),
                pa.array(get(lambda s: s.tags), pa.list_(pa.string())),
                pa.array(get(lambda s: s.vbr), pa.string()),
                pa.array(get(lambda s: s.crc_checked), pa.int64()),
                pa.array(get(lambda s: s.crc_bad), pa.int64()),
                pa.array(get(lambda s: s.resyncs), pa.int64()),
                pa.array(get(lambda s: s.offsets.tolist()), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "duration_us", "n_frames", "sample_rate", "tags", "vbr", "crc_checked", "crc_bad", "resyncs", "frame_offsets"])

    return narrow.mapInArrow(run, schema)
