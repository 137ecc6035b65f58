from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prefixlake.llm import media
from tests.llm.conftest import ODD


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=6000))
def test_round_trip(payload):
    s = media.read_stream(media.write_stream(payload))
    assert s.payload == payload and not s.crc_bad and not s.skipped and s.table == "Xing" and s.table_frames == len(s.offsets) == s.crc_good
    assert s.samples == 1152 * len(s.offsets) and s.header.rate == 32000


def test_damage_is_skipped_and_counted():
    raw = media.write_stream(bytes(range(256)) * 40)
    whole = media.read_stream(raw)
    cut = whole.offsets[3]
    s = media.read_stream(b"junk\xff\xfb!" + raw[:cut] + b"\x00" * 100 + raw[cut:] + b"TAG" + b"t" * 125)
    assert len(s.offsets) == len(whole.offsets) and s.skipped == 107 and s.payload == whole.payload
    bad = bytearray(raw)
    bad[whole.offsets[2] + 8] ^= 1  # inside the side information that the checksum covers
    assert media.read_stream(bytes(bad)).crc_bad == 1
    assert media.read_stream(raw[: whole.offsets[-1] + 10]).offsets == whole.offsets[:-1]


def test_headers_of_other_kinds():
    assert media.parse_header(bytes([0xFF, 0xFB, 0x90, 0x00])).length == 417  # MPEG-1 layer III, 128 kbit/s, 44.1 kHz
    assert media.parse_header(bytes([0xFF, 0xF3, 0x40, 0xC0])).samples == 576  # MPEG-2 layer III
    assert media.parse_header(bytes([0xFF, 0xFF, 0x10, 0x00])).samples == 384  # MPEG-1 layer I
    assert media.parse_header(bytes([0xFF, 0xEB, 0x90, 0x00])) is None and media.parse_header(b"\xff\xfb\xf0\x00") is None


def test_operator(spark, documents):
    docs = documents(ODD).selectExpr("*", "'x' as media", "1 as payload")
    got = {r["doc_id"]: r for r in media.feature(media.read_media(media.write_media(docs))).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")
        assert got[i]["n_bytes"] == len(raw) and bytes(got[i]["payload"]) == padded and got[i]["crc_bad"] == 0
        assert got[i]["media_sha256"] == hashlib.sha256(media.write_stream(padded)).hexdigest() and zlib.crc32(got[i]["payload"][-64:]) == zlib.crc32(padded[-64:])
    assert got[3]["feature"] == got[4]["feature"]
    none = spark.createDataFrame([(1, 0, None), (2, 0, b"")], "doc_id long, n_bytes long, media binary")
    assert [(r["frames"], bytes(r["payload"])) for r in media.read_media(none).collect()] == [(0, b""), (0, b"")]


def test_payload_that_looks_like_a_trailing_tag():
    """The bytes of an ID3v1 tag inside the last frame are payload; after it they are a tag."""
    for size in (64, 1004, 1024, 2048, 3000):
        plain = media.write_stream(bytes(size))
        at = len(plain) - 128
        for k in range(size - 2):
            payload = bytes(k) + b"TAG" + bytes(size - k - 3)
            data = media.write_stream(payload)
            if data[at : at + 3] == b"TAG":
                assert media.read_stream(data).payload == payload
                tagged = media.read_stream(data + (b"TAG" + b"title").ljust(128, b"\x00"))
                assert tagged.payload == payload and tagged.tags["TIT2"] == "title" and tagged.skipped == 0
                break
        else:
            assert size == 64


@pytest.mark.parametrize("mark", [b"TAG", b"ID3\x04\x00\x00\x00\x00\x00\x05", b"\xff\xfa\x18\xc0", b"\xff\xfb\x18\xc0", b"Xing\x00\x00\x00\x07", b"VBRI"])
@pytest.mark.parametrize("size", [64, 192, 1024, 1472, 2880])
def test_any_mark_anywhere_in_a_payload_comes_back(mark, size):
    for at in range(max(0, size - 1440), size - len(mark) + 1):
        payload = bytes(at) + mark + b"a" * (size - at - len(mark))
        found = media.read_stream(media.write_stream(payload))
        assert found.payload == payload and found.skipped == 0 and found.crc_bad == 0 and len(found.offsets) == -(-size // 1417)
