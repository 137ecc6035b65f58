from __future__ import annotations

import numpy as np

from prefixlake.llm import licences
from tests.llm.conftest import ODD

MIT = licences.TEMPLATES["MIT"].strip()


def found(documents, texts, **options):
    rows = licences.scan(documents(texts), **options).collect()
    return sorted((r["doc_id"], r["licence"], round(r["coverage"], 2), r["matched_text"]) for r in rows)


def test_whole_edited_and_foreign_texts(documents):
    edited = MIT.replace("hereby granted", "hereby now granted").replace("sublicense, ", "").upper()
    texts = ["é " * 30 + MIT, "intro. " + edited + " tail", "Released under the MIT License.", MIT[: len(MIT) // 3], "a licence is a licence", *ODD]
    got = found(documents, texts)
    assert [(d, n) for d, n, _, _ in got] == [(0, "MIT"), (1, "MIT"), (2, "MIT notice")] and got[0][2] == 1.0 and 0.95 < got[1][2] < 1
    assert got[0][3] == MIT.rstrip(".") and texts[0].index(got[0][3]) == 60


def test_every_occurrence(documents):
    line = "Licensed under the Apache License, Version 2.0."
    assert len(found(documents, [f"{line} middle words here\n{line}\n{line}"])) == 3


def test_spans_are_code_points(documents):
    text = "ÄÖÜ 漢字 Released under the MIT License!"
    (r,) = licences.scan(documents([text])).collect()
    assert text[r["start"] : r["end"]] == r["matched_text"] == "Released under the MIT License"


def test_shared_runs_share_a_fingerprint():
    rng = np.random.default_rng(7)
    shared = rng.integers(0, 1 << 60, licences.GRAM + licences.WINDOW - 1, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 9), dtype=np.uint64), shared, rng.integers(0, 1 << 60, rng.integers(0, 9), dtype=np.uint64)]) for _ in range(2))
        x, y = (set(licences.fingerprints(w, np.array([0, len(w)]))[0].tolist()) for w in (a, b))
        assert x & y


def test_banded_alignment_equals_full_where_the_band_is_wide_enough():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = rng.integers(0, 4, 9).astype(np.uint64), rng.integers(0, 4, 9).astype(np.uint64)
        table = np.zeros((10, 10), int)
        for i in range(9):
            for j in range(9):
                if abs(i - j) <= licences.band_of(a):
                    table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else 0
                table[i + 1, j + 1] = max(table[i + 1, j + 1], table[i, j + 1], table[i + 1, j])
        assert licences.align(a, b, 0, licences.band_of(a))[0] == table[-1, -1]


def test_every_template_is_found_as_itself_whole_edited_and_split(documents):
    """Over all templates: unchanged, with every fifteenth word changed, and with forty words put into the middle."""
    rng, texts, names = np.random.default_rng(3), [], []
    for name, text in sorted(licences.TEMPLATES.items()):
        words = text.split()
        texts.append("before it " + text + " after it")
        names.append(name)
        if len(words) >= licences.LONG:
            texts.append(" ".join(w if i % 15 != 7 or any(c.isdigit() for c in w) else f"x{rng.integers(1 << 30)}" for i, w in enumerate(words)))
            texts.append(" ".join([*words[: len(words) // 2], *(f"y{i}" for i in range(40)), *words[len(words) // 2 :]]))
            names += [name, name]
    got = {}
    for d, n, c, _ in found(documents, texts):
        got.setdefault(d, []).append((n, c))
    for d, name in enumerate(names):
        best = [x for x in got.get(d, []) if x[0] == name]
        assert len(best) == 1 and best[0][1] >= 0.88, (name, d, got.get(d))


def test_versions_clauses_and_parts(documents):
    bsd2, bsd3 = licences.TEMPLATES["BSD-2-Clause"], licences.TEMPLATES["BSD-3-Clause"]
    texts = [bsd2, bsd3, licences.TEMPLATES["GPL-2.0 header"], licences.TEMPLATES["GPL-3.0 header"], MIT[: 2 * len(MIT) // 3], licences.NOTICES["GPL-2.0 notice"]]
    got = found(documents, texts)
    assert [(d, n) for d, n, _, _ in got] == [(0, "BSD-2-Clause"), (1, "BSD-3-Clause"), (2, "GPL-2.0 header"), (3, "GPL-3.0 header"), (4, "MIT"), (5, "GPL-2.0 notice")]
    assert 0.6 < got[4][2] < 0.72


def test_empty(documents):
    assert found(documents, []) == []
