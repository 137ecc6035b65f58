from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefixlake.llm import mixing
from tests.llm.conftest import ODD, SCHEMA


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8))
def test_targets_fill_the_whole_and_stop_at_the_cap(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 3.0)
    assert sum(got) == pytest.approx(sum(sizes))
    free = [g / w for g, w, s in zip(got, weights, sizes, strict=True) if g < 3 * s - 1e-9]
    assert all(g <= 3 * s + 1e-6 for g, s in zip(got, sizes, strict=True)) and (not free or max(free) - min(free) < 1e-6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(0, 60))
def test_apportion_is_highest_quotients(votes, seats):
    most = [30] * len(votes)
    want = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] and want[i] < most[i]]
        if not open_:
            break
        want[max(open_, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    got = mixing.apportion(votes, seats, most)
    quotient = lambda x: sorted(v / (2 * n + 1) for v, n in zip(votes, x, strict=True))
    assert sum(got) == sum(want) and quotient(got) == pytest.approx(quotient(want))


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 7)
    monkeypatch.setattr(mixing, "FANOUT", 2)
    texts = [*ODD, *[" ".join(["w"] * (3 + i % 9)) for i in range(80)]]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.plan(docs)
    got = {r["doc_id"]: r for r in plan.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert len(got) == len(texts) and all(got[i]["size"] == size[i] and 0 <= got[i]["taken"] <= 3 * size[i] for i in size)
    by = {}
    for i, _, _, s, _ in rows:
        by.setdefault(s, []).append(got[i])
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.01 * own[0]["target"] + 64
    again = {r["doc_id"]: r["taken"] for r in mixing.plan(docs.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    made = mixing.materialise(docs, plan)
    assert made.columns == docs.columns
    count = made.select("doc_id", mixing.words(F.col("text")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in count} == {i: r["taken"] for i, r in got.items() if r["taken"]}


def test_quotas_down_the_tree(spark, monkeypatch):
    """Every source's blocks are dealt out whole, in proportion, and no shard gets more than its cap."""
    monkeypatch.setattr(mixing, "FANOUT", 4)
    sizes = {"a": [100 + i % 7 for i in range(70)], None: [5, 0, 900], "c": [3]}
    blocks = {"a": 1000, None: 170, "c": 2}
    rows = [(s, i, n, blocks[s]) for s, own in sizes.items() for i, n in enumerate(own)]
    got = mixing.shard_quotas(spark.createDataFrame(rows, "source string, shard long, shard_size long, blocks long"), 3.0, 16).collect()
    assert len(got) == len(rows)
    for s, own in sizes.items():
        quota = {r["shard"]: r["quota"] for r in got if r["source"] == s}
        assert sum(quota.values()) == min(blocks[s], sum(mixing.most_blocks(n, 3.0, 16) for n in own))
        assert all(quota[i] <= mixing.most_blocks(n, 3.0, 16) for i, n in enumerate(own))
        assert max(abs(quota[i] - blocks[s] * n / sum(own)) for i, n in enumerate(own)) <= 5


def test_capped_sources_are_taken_whole(spark, monkeypatch):
    """A source at its cap comes within a block of three laps, though blocks don't divide its shards."""
    monkeypatch.setattr(mixing, "SHARD_DOCS", 3)
    rows = [(i, "w " * (1 + i % 5), "en", "big" if i < 400 else "a small one", 0) for i in range(410)]
    got = mixing.plan(spark.createDataFrame(rows, SCHEMA)).where("doc_id >= 400").collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got) and got[0]["target"] == 3 * got[0]["source_size"]
    assert sum(r["taken"] for r in got) > got[0]["target"] - mixing.BLOCK


def test_no_name_is_taken(spark, documents):
    names = ["_id", "_a", "_b", "_size", "size", "a", "b", "run", "row", "laps", "from1", "taken", "n_lines", "sequence_id", "odd `name`"]
    docs = documents([f"{'w ' * (30 + i)}" for i in range(20)]).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    made = mixing.materialise(docs, mixing.plan(docs))
    rows = made.collect()
    assert made.columns == docs.columns and rows and all([r[c] for c in names] == list(range(len(names))) for r in rows)


def test_empty(documents):
    assert mixing.plan(documents([])).count() == 0 and mixing.plan(documents([None, ""])).where("taken <> 0 or target <> 0").count() == 0
