"""The pipeline over the smallest table against plain Python, stage by stage on what the stage before kept."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from prefixlake.llm import packing, quality
from prefixlake.llm.shared import written
from tests.llm.test_linededup import brute as line_brute
from tests.llm.test_neardup import brute as near_brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage got and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = written(stage(spark, given, SF), name)
        out[name] = (given.orderBy("doc_id").collect(), docs.collect(), given, docs)
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_language(stages):
    """Kept is what the model accepts, judged text by text."""
    before, after, given, _ = stages["language"]
    model = quality.fit_language(given)
    kept = {r["doc_id"] for r in before if re.search(r"[^\W\d_]", r["text"] or "") and model.judged(pa.array([r["text"]]))[2][0]}
    assert {r["doc_id"] for r in after} == kept and len(kept) >= 0.95 * len(before)


def test_line_dedup(stages):
    before, after, _, _ = stages["line_dedup"]
    want = line_brute([r["text"] for r in before], 10)
    assert texts(after) == {r["doc_id"]: w[2] for r, w in zip(before, want, strict=True)} and any(w[1] for w in want)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_dedup(stages):
    before, after, _, _ = stages["near_dedup"]
    want = near_brute([r["text"] for r in before], 5, 80)
    assert {r["doc_id"] for r in after} == {before[i]["doc_id"] for i, (_, root) in enumerate(want) if root == i} and len(after) < len(before)


def shares(sizes, weights, cap=3.0):
    """Weights applied again and again to what capped sources leave."""
    out, total = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in sizes if s not in out]
        left, weight = total - sum(out.values()), sum(weights[s] for s in free)
        above = [s for s in free if left * weights[s] / weight > cap * sizes[s]]
        if not above:
            return out | {s: left * weights[s] / weight for s in free}
        out |= {s: cap * sizes[s] for s in above}


def test_mix_sources(stages):
    """Each source gives its target to a block; every piece is a run of words of its document, none taken more than three times."""
    before, after, _, _ = stages["mix_sources"]
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    by = Counter()
    for i, n in size.items():
        by[source[i]] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = shares(by, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken, per = Counter(), Counter()
    original = texts(before)
    for r in after:
        n = len(WORD.findall(r["text"]))
        assert r["text"] in original[r["doc_id"]] and n >= 1
        taken[source[r["doc_id"]]] += n
        per[r["doc_id"]] += n
    assert all(abs(taken[s] - goal[s]) <= 16 for s in order) and all(per[i] <= 3 * size[i] for i in size)


def test_pack(stages):
    """Tokens, cuts and places against the tokeniser itself."""
    before, after, _, _ = stages["pack"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for r in before:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            piece = ids[k : k + 4096]
            want[r["doc_id"], k // 4096, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    fills = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fills.get(r["sequence_id"], 0)
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fills.values()) <= 4096 and len(fills) <= sum(fills.values()) / 4096 * 1.05 + 1


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages["pack"][1])
