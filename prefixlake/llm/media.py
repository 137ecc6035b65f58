"""MPEG audio as a media column: payloads stored in frames, streams read back frame by frame.

Writing puts bytes into the ancillary part of MPEG-1 layer III frames (32 kHz, mono, checksummed,
silent): an ID3v2.4 tag with the payload's size, an information frame with the variable-bitrate
table (frame count, byte count, 100 seek points), then 320 kbit/s frames and one last frame of the
least bitrate that holds the rest.

Reading takes any stream: it skips ID3v2 and ID3v1 tags, finds the first header that a second one
confirms, follows the chain of headers, and after damage resynchronises and counts the bytes lost.
It reads Xing, Info and VBRI tables, verifies the CRC-16 of layer III frames that carry one, and
returns the exact duration (samples over rate), every frame's byte offset, and the payload.

Defined results: null or empty media has no frames and an empty payload; equal bytes give equal
values, so ties and repeated rows need no order; a null text is written as an empty one; a stream
whose payload is shorter than its tag says is not ``complete``; free-format frames are not followed;
an empty table gives an empty result; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.textarrays import chunks

# Fixed values of the MPEG-1, MPEG-2 and MPEG-2.5 audio formats: kbit/s by index 1 to 14, and sampling rates.
_BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

PAYLOAD_TAG = "payload-bytes"
_SIDE = 17  # side information of a mono MPEG-1 layer III frame
_OVERHEAD = 4 + 2 + _SIDE


@dataclass(frozen=True)
class Header:
    """One frame header."""

    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    checked: bool
    bitrate: int
    rate: int
    channels: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        if self.version == 3:
            return 17 if self.channels == 1 else 32
        return 9 if self.channels == 1 else 17


@lru_cache(maxsize=4096)
def parse_header(head: bytes) -> Header | None:
    """The header in four bytes, or None if they are not one."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    bit, rate = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or bit in (0, 15) or rate == 3 or head[3] & 3 == 2:
        return None
    kbit, hertz, pad = _BITRATES[(1 if version == 3 else 2, layer)][bit - 1], _RATES[version][rate], head[2] >> 1 & 1
    if layer == 1:
        length, samples = (12_000 * kbit // hertz + pad) * 4, 384
    elif layer == 3 and version != 3:
        length, samples = 72_000 * kbit // hertz + pad, 576
    else:
        length, samples = 144_000 * kbit // hertz + pad, 1152
    return Header(version, layer, not head[1] & 1, kbit, hertz, 1 if head[3] >> 6 == 3 else 2, length, samples)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, from 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _head(bit: int, checked: bool) -> bytes:
    return bytes([0xFF, 0xFA | (not checked), bit << 4 | 2 << 2, 0xC0])


def write_stream(payload: bytes) -> bytes:
    """A stream that carries ``payload``; see the module's text."""
    text = b"\x03" + PAYLOAD_TAG.encode() + b"\x00" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(tag)) + tag
    frames = []
    for at in range(0, len(payload), 1440 - _OVERHEAD):
        part = payload[at : at + 1440 - _OVERHEAD]
        bit = next(i for i in range(1, 15) if _BITRATES[1, 3][i - 1] * 9 // 2 >= len(part) + _OVERHEAD)
        head = _head(bit, True)
        side = bytes(_SIDE)
        body = head + struct.pack(">H", crc16(head[2:] + side)) + side + part
        frames.append(body.ljust(_BITRATES[1, 3][bit - 1] * 9 // 2, b"\x00"))
    info = 360  # the information frame: 80 kbit/s
    sizes = [len(f) for f in frames]
    total = info + sum(sizes)
    ends, points, at, k = total, bytearray(), info, 0
    for percent in range(100):
        goal = percent * len(frames) // 100
        while k < goal:
            at += sizes[k]
            k += 1
        points.append(min(255, at * 256 // ends))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(points)
    return tag + (_head(6, False) + bytes(_SIDE) + table).ljust(info, b"\x00") + b"".join(frames)


@dataclass
class Stream:
    """What reading found."""

    header: Header | None = None
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    samples: int = 0
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    seek_points: list[int] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _read_id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads text frames of the tag at ``at`` into ``tags``; returns where the tag ends."""
    size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
    end, pos, major = min(len(data), at + 10 + size), at + 10, data[at + 3]
    while pos + 10 <= end and data[pos : pos + 4].isalnum():
        raw = data[pos + 4 : pos + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if major >= 4 else int.from_bytes(raw, "big")
        body = data[pos + 10 : min(end, pos + 10 + n)]
        if data[pos : pos + 1] == b"T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            name, _, value = body[1:].decode(code, "replace").partition("\x00")
            key = data[pos : pos + 4].decode("latin-1")
            tags[name if key == "TXXX" else key] = value if key == "TXXX" else name
        pos += 10 + n
    return end + (10 if data[at + 5] & 0x10 else 0)


def _is_tag(data: bytes, at: int) -> bool:
    return data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128


def _alike(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame at ``at`` is an information frame; reads its table."""
    xing = at + 4 + h.side
    if h.layer == 3 and data[xing : xing + 4] in (b"Xing", b"Info") and at + h.length <= len(data) and xing + 8 <= at + h.length:
        flags, pos = int.from_bytes(data[xing + 4 : xing + 8], "big"), xing + 8
        out.table = data[xing : xing + 4].decode()
        if flags & 1:
            out.table_frames, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
        if flags & 2:
            out.table_bytes, pos = int.from_bytes(data[pos : pos + 4], "big"), pos + 4
        if flags & 4:
            out.seek_points = list(data[pos : pos + 100])
        return True
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= min(len(data), at + h.length):
        _, _, _, out.table_bytes, out.table_frames, n, scale, width, _ = struct.unpack(">HHHIIHHHH", data[at + 40 : at + 62])
        out.table = "VBRI"
        rows = [data[at + 62 + i * width : at + 62 + (i + 1) * width] for i in range(n)]
        out.seek_points = [int.from_bytes(r, "big") * scale for r in rows]
        return True
    return False


def read_stream(data: bytes) -> Stream:
    """Everything the frames and tags of ``data`` say; see the module's text."""
    out, pos, parts, sure = Stream(), 0, [], False
    # A frame of the chain that ends where the data ends holds a "TAG" there as its own bytes.
    whole = len(data)
    end = whole - 128 if whole >= 128 and data[-128:-125] == b"TAG" else whole
    while pos < end:
        if _is_tag(data, pos):
            pos = _read_id3v2(data, pos, out.tags)
            continue
        h = parse_header(data[pos : pos + 4])
        good = h is not None and (pos + h.length <= end or (sure and pos + h.length == whole)) and (out.header is None or _alike(h, out.header))
        if good and not sure:
            # A first frame counts once the next header, a tag or the end confirms it.
            after = pos + h.length
            follow = parse_header(data[after : after + 4])
            good = after == end or _is_tag(data, after) or (follow is not None and _alike(h, follow))
        if not good:
            sure = False
            ahead = [x for x in (data.find(b"\xff", pos + 1, end), data.find(b"ID3", pos + 1, end)) if x > 0]
            step = min(ahead, default=end)
            out.skipped += step - pos
            pos = step
            continue
        first = out.header is None
        out.header, sure = out.header or h, True
        if not (first and _table(data, pos, h, out)):
            out.offsets.append(pos)
            out.lengths.append(h.length)
            out.samples += h.samples
            if h.layer == 3:
                body = pos + 4 + 2 * h.checked
                if h.checked:
                    right = crc16(data[pos + 2 : pos + 4] + data[body : body + h.side]) == int.from_bytes(data[pos + 4 : pos + 6], "big")
                    out.crc_good += right
                    out.crc_bad += not right
                parts.append(data[body + h.side : pos + h.length])
        pos += h.length
    if pos <= end < whole:
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1"))
    size = out.tags.get(PAYLOAD_TAG, "")
    out.payload = b"".join(parts)[: int(size) if size.isdigit() else None]
    return out


STEP = 4 << 20


def write_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every text: UTF-8, zeros appended to a positive multiple of 64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text"), size=STEP):
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                media = [write_stream(t.ljust(max(64, -(-len(t) // 64) * 64), b"\x00")) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FOUND = (
    "doc_id long, n_bytes long, payload binary, complete boolean, media_bytes long, media_sha256 string, version string, layer int, sample_rate int, channels int, frames long, samples long, duration double, "
    "vbr_table string, vbr_frames long, crc_good long, crc_bad long, skipped long, frame_offsets array<long>"
)


def read_media(media: DataFrame) -> DataFrame:
    """The columns ``FOUND`` of every (doc_id, n_bytes, media) row: payload, format, exact duration, offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("media")]
            while at < batch.num_rows:
                to, held = at + 1, sizes[at]
                while to < batch.num_rows and held + sizes[to] <= STEP:
                    held += sizes[to]
                    to += 1
                part = batch.slice(at, to - at)
                found = [read_stream(x or b"") for x in part.column("media").to_pylist()]
                heads = [s.header for s in found]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": part.column("n_bytes"),
                    "payload": pa.array([s.payload for s in found], pa.binary()),
                    "complete": pa.array([len(s.payload) == int(s.tags[PAYLOAD_TAG]) if s.tags.get(PAYLOAD_TAG, "").isdigit() else None for s in found], pa.bool_()),
                    "media_bytes": pa.array(sizes[at:to], pa.int64()),
                    "media_sha256": pa.array([hashlib.sha256(x or b"").hexdigest() for x in part.column("media").to_pylist()], pa.string()),
                    "version": pa.array([{3: "1", 2: "2", 0: "2.5"}[h.version] if h else None for h in heads], pa.string()),
                    "layer": pa.array([h.layer if h else None for h in heads], pa.int32()),
                    "sample_rate": pa.array([h.rate if h else None for h in heads], pa.int32()),
                    "channels": pa.array([h.channels if h else None for h in heads], pa.int32()),
                    "frames": pa.array([len(s.offsets) for s in found], pa.int64()),
                    "samples": pa.array([s.samples for s in found], pa.int64()),
                    "duration": pa.array([s.samples / s.header.rate if s.header else 0.0 for s in found], pa.float64()),
                    "vbr_table": pa.array([s.table or None for s in found], pa.string()),
                    "vbr_frames": pa.array([s.table_frames if s.table_frames >= 0 else None for s in found], pa.int64()),
                    "crc_good": pa.array([s.crc_good for s in found], pa.int64()),
                    "crc_bad": pa.array([s.crc_bad for s in found], pa.int64()),
                    "skipped": pa.array([s.skipped for s in found], pa.int64()),
                    "frame_offsets": pa.array([s.offsets for s in found], pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                at = to

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FOUND)


def feature(found: DataFrame) -> DataFrame:
    """``found`` with one string of its format, frames, duration and checks."""
    parts = [
        F.concat(F.lit("mpeg"), F.coalesce("version", F.lit("?")), F.lit(" layer "), F.coalesce(F.col("layer").cast("string"), F.lit("?"))),
        *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("none"))) for n in ("sample_rate", "channels", "frames", "samples", "vbr_table", "vbr_frames", "crc_good", "crc_bad", "skipped")),
        F.concat(F.lit("last_offset="), F.coalesce(F.element_at("frame_offsets", -1).cast("string"), F.lit("none"))),
    ]
    return found.withColumn("feature", F.concat_ws(";", *parts))
