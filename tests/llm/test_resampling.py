from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from prefixlake.llm import catalog, resampling
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def features(text, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def expected(rows, target, percent=5, least=20):
    """Plainly, with every n-gram as a string."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    out = {}
    able = []
    for i, text in rows:
        n, own = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in own)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(own), weight, score, None]
        if n >= least:
            able.append((-score, i))
    for k, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100]):
        out[i][3] = k + 1
    return out


def test_whole_table_against_strings(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = catalog.op11_resampling(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert {r[0]: list(r)[1:] for r in got.collect()} == expected(docs, target)


def test_odd_texts_ties_and_clashing_columns(spark, documents):
    texts = [*ODD, *[f"the quick brown fox {i % 3} jumps over a lazy dog " * 4 for i in range(60)], "x" * 70 + " " + "ß" * 500 + " 漢字 tail"]
    docs = documents(texts).selectExpr("*", "1 as weight", "'a' as rank", "2 as _row", "3 as score", "'x' as bucket")
    target = spark.createDataFrame([(None,), ("the lazy fox",), ("",)], "text string")
    got = {r["doc_id"]: list(r)[1:] for r in resampling.draw(docs, target, percent=50).collect()}
    assert got == expected(list(enumerate(texts)), [None, "the lazy fox", ""], percent=50)


def test_nothing(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert resampling.draw(documents([]), none).count() == 0
    assert [list(r)[1:3] for r in resampling.draw(documents([None]), none).collect()] == [[0, 0]]
    lost = documents(["a b c " * 20, "a b c " * 20]).selectExpr("cast(null as long) as doc_id", "text")
    assert sorted(r["rank"] for r in resampling.draw(lost, none, percent=100).collect()) == [1, 2]


def test_many_partitions_rank_without_gaps(spark, documents):
    docs = documents([f"{'w ' * 20}{i}" for i in range(300)]).repartition(13)
    rows = resampling.draw(docs, docs, percent=30).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 91))
    assert [(-r["score"], r["doc_id"]) for r in rows] == sorted((-r["score"], r["doc_id"]) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=200), min_size=1, max_size=8))
def test_composed_crcs(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    crc = resampling.word_crcs(data, ends - [len(w) for w in words], ends)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    whole, far = np.uint32(0), np.array([(1 << 20) + 12_345])
    for c, w in zip(crc, words, strict=True):
        whole = resampling.shifted(np.array([whole]), np.array([len(w)]))[0] ^ c
    assert whole == zlib.crc32(b"".join(words))
    assert resampling.shifted(crc[:1], far)[0] ^ zlib.crc32(bytes(int(far[0]))) == zlib.crc32(words[0] + bytes(int(far[0])))


def test_buckets_of_one_text():
    (first, word, found), = resampling.bucketed(pa.array(["Don't stop: ÄÖ 9x"]))
    assert first == 0 and word.tolist() == [0, 5]
    assert [b for bucket, inside in found for b in bucket[inside].tolist()] == features("Don't stop: ÄÖ 9x")[1]
