"""Numpy views over Arrow text columns: words, hashes and per-document slices without Python strings.

Everything here runs inside a Spark task on one Arrow batch at a time, in chunks of about
``CHUNK`` bytes, so a task's memory is bounded by its batch plus its longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(base: int, bits: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for every i under 2 ** bits."""
    out = np.ones(1, np.uint64)
    for k in range(bits):
        out = np.concatenate([out, out * np.uint64(pow(base, 1 << k, 1 << 64))])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``size`` bytes. A null text is empty.

    ``lower`` folds A-Z to a-z and nothing else.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = np.frombuffer(part.tobytes().translate(_LOWER), np.uint8)
        yield first, part, offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each document's first word's number."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    left = np.empty(len(data), bool)
    left[0], left[1:] = True, ~inside[:-1]
    right = np.empty(len(data), bool)
    right[-1], right[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (left | edge[:-1]))
    ends = np.flatnonzero(inside & (right | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: polynomials over random byte values, by one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    bits = max(20, int(len(data)).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, bits)[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_INVERSE, bits)[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its ``width``-word shingles), A-Z folded.

    A text with fewer words has one shingle, the whole sequence; one without words has none.
    """
    for first, data, offsets in chunks(texts, lower=True):
        starts, ends, word = word_spans(data, offsets)
        h = span_hashes(data, starts, ends)
        n = max(0, len(h) - width + 1)
        joined = np.zeros(n, np.uint64)
        for k in range(width):
            joined = joined * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        joined = mix(joined)
        for i in range(len(offsets) - 1):
            a, b = word[i], word[i + 1]
            if b - a >= width:
                yield first + i, np.unique(joined[a : b - width + 1])
            elif b > a:
                short = 0
                for x in h[a:b].tolist():
                    short = (short * 0xD6E8FEB86659FD93 + x) % (1 << 64)
                yield first + i, mix(np.array([(short + int(b - a)) % (1 << 64)], np.uint64))
            else:
                yield first + i, np.zeros(0, np.uint64)
