"""Licence scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

A text is read as words of letters and digits, A-Z folded. Runs of ``GRAM`` words are hashed, and of
every ``WINDOW`` neighbouring hashes the least is a fingerprint; texts that share a run of
``GRAM + WINDOW - 1`` words share a fingerprint. The templates' fingerprints form an inverted index
of fixed size. A document's fingerprints that meet it are put together by template and diagonal;
segments that follow each other in both texts are chained, so inserted lines or columns don't part a
licence, and are aligned word by word within a band around each diagonal. A match is reported if its
words cover ``min_coverage`` of a short template, ``min_part`` of one of ``LONG`` words or more, with the
coverage itself. Words with digits of notices and headers, their versions, must all be there. Among
overlapping matches the one with more words stays, then the one more fully covered.

Defined results: null, empty and wordless texts have no match; repeated rows each report theirs; an
empty table gives an empty result; a licence that occurs several times is reported each time; ties of
two templates on one span go to the first by place, then by name; columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prefixlake.llm.textarrays import chunks, mix, span_hashes, word_spans

GRAM, WINDOW, BAND = 3, 3, 12

LONG = 40  # words from which a part of a template counts as found

# Fixed texts: common notices and headers of public licences; their whole texts are files beside this module.
NOTICES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT notice (licensed)": "Licensed under the MIT License.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version."
    ),
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

TEMPLATES = NOTICES | {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    folded = np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)
    starts, ends, word = word_spans(folded, offsets)
    return span_hashes(folded, starts, ends), starts, ends, word


def fingerprints(words: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed (hash, place) pairs of texts laid end to end; ``begins`` are their first words and the end."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    h = mix(h)
    last = np.repeat(begins[1:], np.diff(begins))[:n]
    places = np.arange(n)
    whole = places + GRAM <= last
    h = np.where(whole, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    chosen = np.zeros(n, bool)
    if n < WINDOW:
        chosen[np.argmin(h)] = True
    else:
        windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        chosen[np.arange(len(windows)) + windows.argmin(axis=1)] = True
    # A text with fewer runs than a window offers its runs as they are.
    short = np.flatnonzero(np.diff(begins) < GRAM + WINDOW - 1)
    for t in short.tolist():
        chosen[begins[t] : min(n, begins[t + 1])] = True
    at = np.flatnonzero(chosen & whole)
    return h[at], at


@dataclass
class Index:
    """The inverted index: sorted fingerprints with the template and place of each."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray
    sizes: list[int]  # fingerprints of each template
    versions: list[set[int]]  # hashes of each template's words with a digit


def build_index(templates: dict[str, str]) -> Index:
    names, words, found, sizes, versions = sorted(templates), [], [], [], []
    for k, name in enumerate(names):
        data = np.frombuffer(templates[name].encode(), np.uint8)
        own, starts, ends, _ = _words(data, np.array([0, len(data)]))
        words.append(own)
        versions.append({int(w) for w, a, b in zip(own, starts, ends, strict=True) if any(48 <= x <= 57 for x in data[a:b])})
        h, at = fingerprints(own, np.array([0, len(own)]))
        sizes.append(len(at))
        found += [(int(x), k, int(p)) for x, p in zip(h, at, strict=True)]
    found.sort()
    return Index(names, words, np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64), sizes, versions)


def band_of(template: np.ndarray) -> int:
    """Half the band's width: so far under a template's length that two occurrences never share a band."""
    return max(1, min(BAND, len(template) // 3))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence inside the band around diagonal ``shift``: (words, first, end) in ``text``."""
    low, width = shift - band, 2 * band + 1
    score = [(0, -1, -1)] * (width + 1)  # best up to template row i, by diagonal; (words, -first, end)
    best, words = (0, 0, 0), text.tolist()
    for i, w in enumerate(template.tolist()):
        row: list[tuple[int, int, int]] = []
        left = (0, -1, -1)
        for d in range(width):
            j = i + low + d
            up = score[d + 1]
            here = max(left, up, key=lambda s: s[0])
            if 0 <= j < len(words) and words[j] == w:
                n, first, _ = score[d]
                if n + 1 > here[0]:
                    here = (n + 1, first if n else j, j)
            row.append(here)
            left = here
            if here[0] > best[0]:
                best = (here[0], here[1], here[2] + 1)
        score = [*row, (0, -1, -1)]
    return best


@dataclass
class Segment:
    """Fingerprints of one template that meet a text on neighbouring diagonals: places in both, and how many."""

    t0: int
    t1: int
    d0: int
    d1: int
    shift: int
    n: int


def segments(places: list[tuple[int, int]], band: int) -> list[Segment]:
    """The (template place, text place) pairs of one template, put together by diagonal, in the text's order."""
    out: list[list[tuple[int, int]]] = []
    for t, d in sorted(places, key=lambda p: (p[1] - p[0], p[1])):
        if out and d - t - (out[-1][0][1] - out[-1][0][0]) <= band:
            out[-1].append((t, d))
        else:
            out.append([(t, d)])
    found = []
    for x in out:
        x.sort(key=lambda p: p[1])
        cuts = [0, *(i for i in range(1, len(x)) if x[i][1] - x[i - 1][1] > 3 * BAND), len(x)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            own = x[i:j]
            found.append(Segment(min(t for t, _ in own), max(t for t, _ in own) + GRAM, own[0][1], own[-1][1] + GRAM, sorted(d - t for t, d in own)[len(own) // 2], len(own)))
    most = max(s.n for s in found)
    # Phrases that a template repeats meet it on stray diagonals; beside real runs they are noise.
    return sorted((s for s in found if 20 * s.n >= most), key=lambda s: s.d0)


def chains(found: list[Segment], length: int, band: int) -> list[list[Segment]]:
    """Segments in the order of template and text, best chains first; each segment is in one chain."""
    left, out = list(found), []
    while left:
        best: list[tuple[int, int]] = []  # fingerprints up to a segment, and the segment before it
        for j, s in enumerate(left):
            before = [(best[i][0], i) for i in range(max(0, j - 64), j) if left[i].t1 - band <= s.t0 and left[i].d1 - band <= s.d0 and left[i].t0 < s.t0 and s.d0 - left[i].d1 <= length]
            n, i = max(before, default=(0, -1))
            best.append((n + s.n, i))
        at = max(range(len(left)), key=lambda j: best[j][0])
        chain = []
        while at >= 0:
            chain.append(at)
            at = best[at][1]
        out.append([left[i] for i in reversed(chain)])
        left = [s for i, s in enumerate(left) if i not in set(chain)]
    return out


def matches(words: np.ndarray, hits: list[tuple[int, int, int]], index: Index, min_coverage: float, min_part: float) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, words matched, first word, end word) of one document's accepted matches.

    ``hits`` are (template, place in it, place in the text). Segments of one template that follow each
    other in both are one match, whatever stands between them.
    """
    found, by_template = [], {}
    for template, t, d in hits:
        by_template.setdefault(template, []).append((t, d))
    for template, places in sorted(by_template.items()):
        own = index.words[template]
        band, least = band_of(own), min_coverage if len(own) < LONG else min_part
        for chain in chains(segments(places, band), len(own), band):
            # A run that covers the least share leaves at least this many fingerprints even where each tenth word is changed.
            if 4 * sum(s.n for s in chain) < least * index.sizes[template] and len(own) >= LONG:
                break
            n, first, end, t_from, d_from = 0, -1, -1, 0, 0
            for k, s in enumerate(chain):
                last = k + 1 == len(chain)
                t0 = max(t_from, s.t0 - (len(own) if len(own) < LONG else band))
                t1 = min(len(own), s.t1 + (len(own) if len(own) < LONG else band)) if last else min(s.t1, chain[k + 1].t0)
                a = max(d_from, t0 + s.shift - band)
                b = min(len(words), max(a, t1 + s.shift + band))
                m, x, y = align(own[t0:t1], words[a:b], t0 + s.shift - a, band)
                if m:
                    n, first, end = n + m, a + x if first < 0 else first, a + y
                    t_from, d_from = max(t1, t_from), a + y
            if n < least * len(own) or n == 0:
                continue
            if len(own) < 4 * LONG and not index.versions[template] <= set(words[first:end].tolist()):
                continue
            found.append((template, n / len(own), n, first, end))
    found.sort(key=lambda m: (-m[2], -m[1], m[3], m[0]))
    kept: list[tuple[int, float, int, int, int]] = []
    for m in found:
        if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


SCHEMA = "doc_id long, licence string, coverage double, matched_words int, template_words int, start long, end long, matched_text string"


def scan(documents: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.9, min_part: float = 0.5) -> DataFrame:
    """One row per licence text found: which, how much of it, and its span in code points."""
    index = build_index(templates or TEMPLATES)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for first, data, offsets in chunks(batch.column("text")):
                words, starts, ends, word = _words(data, offsets)
                h, at = fingerprints(words, word)
                if not len(h) or not len(index.hashes):
                    continue
                low = np.searchsorted(index.hashes, h)
                met = np.flatnonzero(index.hashes[np.minimum(low, len(index.hashes) - 1)] == h)
                docs = np.searchsorted(word, at[met], "right") - 1
                for doc in np.unique(docs).tolist():
                    hits = set()
                    for m in met[docs == doc].tolist():
                        k = int(low[m])
                        while k < len(index.hashes) and index.hashes[k] == h[m]:
                            hits.add((int(index.template[k]), int(index.place[k]), int(at[m] - word[doc])))
                            k += 1
                    own = slice(word[doc], word[doc + 1])
                    raw, base = data[offsets[doc] : offsets[doc + 1]].tobytes(), offsets[doc]
                    for template, coverage, n, a, b in matches(words[own], sorted(hits), index, min_coverage, min_part):
                        x, y = starts[own][a] - base, ends[own][b - 1] - base
                        begin = len(raw[:x].decode("utf-8", "replace"))
                        text = raw[x:y].decode("utf-8", "replace")
                        rows.append((first + doc, index.names[template], coverage, n, len(index.words[template]), begin, begin + len(text), text))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = [None, pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True))], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
