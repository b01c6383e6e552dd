from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

from hypothesis import given
from hypothesis import strategies as st

from quillon.llm import media
from quillon.llm.common import whole_text
from tests.llm.util import empty, odd, odd_rows
from pyspark.sql import functions as F


@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = media.pad(data)
    assert payload.startswith(data) and len(payload) % 576 == 0 and payload
    stored = media.encode(payload)
    stream = media.parse(stored)
    assert media.read_payload(stored, stream) == payload
    assert stream.duration == Fraction(len(payload), 16000) and stream.crc_bad == 0 and stream.crc_checked == len(payload) // 576
    assert (stream.vbr, stream.vbr_frames, stream.vbr_bytes) == ("Info", len(payload) // 576, (len(payload) // 576 + 1) * media.FRAME)
    assert stream.tags == ["id3v2.4"] and not stream.resyncs


def test_resynchronises_after_junk():
    stored = media.encode(media.pad(b"a" * 2000))
    at = int(media.parse(stored).offsets[2])
    broken = stored[:at] + b"\xff\xfbjunk\xff\xf2\xd8" + stored[at:] + b"TAG".ljust(128, b"\0")
    stream = media.parse(broken)
    assert len(stream.offsets) == 4 and stream.resyncs == 1 and stream.skipped == 9 and stream.tags == ["id3v2.4", "id3v1"]
    assert media.read_payload(broken, stream) == media.pad(b"a" * 2000)


def test_checksums_and_cut_frames():
    stored = bytearray(media.encode(media.pad(b"a" * 1000)))
    stored[int(media.parse(bytes(stored)).offsets[1]) + 7] ^= 1
    stream = media.parse(bytes(stored[:-1]))
    assert media.parse(bytes(stored)).crc_bad == 1 and len(stream.offsets) == 1


def test_headers_of_every_layer():
    for version, layer, head in (("1", 3, b"\xff\xfb\x90\x00"), ("1", 1, b"\xff\xff\x90\x00"), ("2", 2, b"\xff\xf5\x80\xc0"), ("2.5", 3, b"\xff\xe3\x40\xc0")):
        h = media.read_header(head, 0)
        assert (h.version, h.layer) == (version, layer) and h.size > 0
    assert media.read_header(b"\xff\xfb\x90\x00", 0).size == 417  # 128 kbit/s at 44.1 kHz
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"abcd"):
        assert media.read_header(bad, 0) is None


def test_vbri_table():
    import struct

    frame = (b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 5000, 9, 2, 1, 2, 1) + b"\0\x0a\0\x14").ljust(417, b"\0")
    stream = media.parse(frame * 1 + (b"\xff\xfb\x90\x00" + bytes(413)) * 3)
    assert (stream.vbr, stream.vbr_frames, stream.vbr_bytes, stream.toc) == ("VBRI", 9, 5000, [10, 20])
    assert stream.samples == 3 * 1152 and stream.duration == Fraction(3 * 1152, 44100)


def test_empty_stream():
    assert media.parse(b"").samples == 0 and len(media.parse(b"junk" * 50).offsets) == 0


def test_column(spark):
    docs = odd(spark).select("doc_id", whole_text(), "media")
    found = media.digest_columns(media.encode_column(docs.withColumn("n_bytes", F.octet_length("text")))).collect()
    assert len(found) == len(odd_rows())
    want = sorted((len(d := (r[1] or "").encode()), hashlib.sha256(media.pad(d)).hexdigest(), zlib.crc32(media.pad(d)[-32:])) for r in odd_rows())
    assert sorted((r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == want
    parsed = media.parse_column(media.encode_column(docs)).collect()
    assert all(r["duration_us"] == r["n_frames"] * 36000 and len(r["frame_offsets"]) == r["n_frames"] for r in parsed)
    assert media.digest_columns(media.encode_column(empty(spark).withColumn("n_bytes", F.lit(0)))).count() == 0


def test_long_streams_and_junk_take_linear_time():
    import time

    small, large = b"\xff\xfb\x50\x00" + bytes(204), b"\xff\xfb\x90\x00" + bytes(413)  # 64 and 128 kbit/s
    assert media.read_header(small, 0).size == 208
    stream = (small + large * 2) * 8000
    began = time.process_time()
    found = media.parse(stream)
    assert len(found.offsets) == 24000 and found.samples == 24000 * 1152 and not found.resyncs
    junk = b"\xff\x00ID3 TA" * 60_000
    assert len(media.parse(junk).offsets) == 0
    assert time.process_time() - began < 8


def test_checksums_of_layer_1():
    h = media.read_header(b"\xff\xfe\x90\xc0", 0)
    assert (h.layer, h.protected, h.channels, h.side) == (1, True, 1, 16)
    joint = media.read_header(b"\xff\xfe\x90\x50", 0)  # joint stereo from subband 8 on
    assert joint.side == 20 and media.read_header(b"\xff\xfe\x90\x00", 0).side == 32
    body = bytes(range(16))
    frame = (b"\xff\xfe\x90\xc0" + media.crc16(b"\x90\xc0" + body).to_bytes(2, "big") + body).ljust(h.size, b"\0")
    found = media.parse(frame * 3)
    assert (found.crc_checked, found.crc_bad, found.samples) == (3, 0, 3 * 384)
    broken = bytearray(frame * 3)
    broken[h.size + 9] ^= 1
    assert media.parse(bytes(broken)).crc_bad == 1


def test_null_and_very_long_media(spark):
    text = "é0123456789 " * 400_000
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    found = {r["doc_id"]: r for r in media.digest_columns(media.encode_column(docs)).collect()}
    assert found[1]["payload_sha256"] == hashlib.sha256(media.pad(text.encode())).hexdigest() and found[2]["payload_bytes"] == 576
    none = media.digest_columns(docs.withColumn("media", F.lit(None).cast("binary"))).filter("doc_id = 2").first()
    assert none["payload_bytes"] == 0 and none["media_bytes"] == 0
