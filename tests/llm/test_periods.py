from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from prefixlake.llm import catalog, periods
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every lag, every island, by the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            stretch = words[s : i + q]
            if len(stretch) >= max(6, 4 * q) and not any(all(a == b for a, b in zip(stretch, stretch[d:])) for d in range(1, q)):  # noqa: B905
                out.append((s, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words):
    numbers = np.unique(np.array(words), return_inverse=True)[1] if words else np.zeros(0, np.int64)
    counts, base = periods.lag_matches(numbers, np.array([0, len(words)]))
    return [tuple(r) for r in periods.runs_of(numbers, counts).tolist()]


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return [len(runs), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None, *digest]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = catalog.op12_periods(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r[0]: list(r)[1:] for r in got.collect()}
    some = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    assert len(rows) == docs.count() and len(some) > 150
    assert {r["doc_id"]: rows[r["doc_id"]] for r in some} == {r["doc_id"]: expected(*r) for r in some}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=30), st.integers(1, 9)), max_size=6))
def test_runs_of_repeated_pieces(pieces):
    words = [w for piece, times in pieces for w in piece * times]
    assert found(words) == brute(words)


def test_runs_of_every_period():
    rng = np.random.default_rng(1)
    for q in (*range(1, 40), 97):
        cycle = rng.integers(0, 5, q).tolist()
        words = [9, *cycle, *cycle, *cycle, *cycle, *cycle[: q // 2], 8, 7, *([1] * 30), *cycle]
        assert found(words) == brute(words)


def test_frequent_and_rare_words_count_alike():
    rng = np.random.default_rng(2)
    rows = [rng.choice(60, 700, p=(x := 1 / np.arange(1, 61)) / x.sum()) for _ in range(3)] + [np.zeros(0, int), np.zeros(90, int)]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    counts, base = periods.lag_matches(np.concatenate(rows), ends)
    for i, r in enumerate(rows):
        assert counts[base[i] + 1 : base[i + 1]].tolist() == [int((r[:-q] == r[q:]).sum()) for q in range(1, len(r) // 4 + 1)]


def test_long_monotonous_texts():
    assert found(["w"] * 200_000) == [(0, 200_000, 1)]
    noisy = np.where(np.random.default_rng(3).random(50_000) < 0.1, np.arange(50_000), -1)
    counts, _ = periods.lag_matches(noisy, np.array([0, len(noisy)]))
    assert all(q == 1 for _, _, q in periods.runs_of(noisy, counts).tolist())


def test_odd_texts_and_clashing_columns(spark, documents):
    docs = documents([*ODD, "to be " * 5 + "or not", "a\tb\na\x0bb\x0ca b a b"]).selectExpr("*", "1 as runs", "2 as collapsed")
    rows = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.find_runs(docs).collect()}
    texts = [t or "" for t in ODD]
    for i, t in enumerate(texts):
        if len(t) < 1000:
            assert rows[i] == (brute([w for w in t.encode().split()]), " ".join(x.decode() for x in t.encode().split()))
    assert rows[8] == ([(0, 60_000, 2)], "a b")
    assert rows[len(ODD)] == ([(0, 10, 2)], "to be or not") and rows[len(ODD) + 1] == ([(0, 8, 2)], "a b")
    assert periods.find_runs(documents([])).count() == 0


def test_planted_loops(spark, documents):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(57))
    docs = documents([text] * 80).unionByName(documents([None, "", " one "]).withColumn("doc_id", F.col("doc_id") + 1000))
    lost = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.unionByName(lost).select("doc_id", F.col("text").alias("before"), periods.looped(F.col("doc_id"), F.col("text")).alias("text")).collect()
    assert sum(r["text"] != r["before"] for r in rows) >= 3
    for r in rows:
        assert (r["text"] or "").split() == ((r["before"] or "").split() if r["doc_id"] is None else planted(r["doc_id"], r["before"]))
