from __future__ import annotations

import re

import numpy as np
import pytest

from prefixlake.llm import neardup
from prefixlake.operators.components import connected_components
from tests.llm.conftest import ODD


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(0, len(words) - width + 1))} or ({tuple(words)} if words else set())


def brute(texts, width, percent):
    sets, parent = [shingles(t, width) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = np.random.default_rng(seed)
    texts = list(ODD)
    for _ in range(8):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(5, 120))]
        for _ in range(rng.integers(1, 8)):
            own = list(base)
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(len(own))] = f"v{rng.integers(1000)}"
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    return texts


@pytest.mark.parametrize(("seed", "block", "work"), [(1, 2048, 1 << 20), (2, 2, 1)])
def test_against_brute_force(spark, documents, monkeypatch, seed, block, work):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "WORK", work)
    texts = corpus(seed)
    got = neardup.near_duplicates(documents(texts), 3, 85).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute(texts, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_of_links_through_a_middle(spark, documents):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[k : k + 80]) for k in (0, 6, 12, 18)]  # neighbours link, ends don't
    got = neardup.near_duplicates(documents(texts), 3, 85).collect()
    assert {r["component_id"] for r in got} == {0} and brute(texts, 3, 85)[3][1] == 0


def test_empty(documents):
    assert neardup.near_duplicates(documents([])).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (20, 21), (21, 22), (22, 20), (5, 1)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9, 10: 9, 20: 20, 21: 20, 22: 20}


def test_bridge_between_leaders_of_different_blocks(spark):
    """Two versions hang on leaders that don't link; one pair in different blocks joins them."""
    x, a, b, y = (set(range(k, k + 40)) for k in (0, 4, 8, 12))  # neighbours of this row link at 80 percent
    blocks = {r["id"]: r["block"] for r in spark.range(100).selectExpr("id", "pmod(xxhash64(id), 2) as block").collect()}
    i, j = (next(i for i in range(10, 100) if blocks[i] == k) for k in (0, 1))
    sets = {0: x, 1: y, 2: x, 3: x, 4: y, i: a, j: b}
    rows = [(7, k, np.array(sorted(v), np.uint64).tobytes()) for k, v in sets.items()]
    members = spark.createDataFrame(rows, "grp long, id long, payload binary")
    links = neardup._links(members, spark.createDataFrame([(7, 2)], "grp long, blocks long"), members.where("id < 2"), lambda payload: neardup._Sets(payload, 80))
    assert {r["component"] for r in connected_components(links).collect()} == {0}


def label_rows(rng, n, groups):
    """Signatures that share their first labels in every order, as boilerplate makes them, in groups of near copies."""
    base = rng.integers(0, 16, (groups, neardup.LABELS)).astype(np.uint8)
    rows = base[rng.integers(0, groups, n)]
    noise = rng.random(rows.shape) < 0.08
    rows = np.where(noise, rng.integers(0, 16, rows.shape), rows).astype(np.uint8)
    rows[:, :12] = base[0, :12]
    return rows


@pytest.mark.parametrize(("work", "held"), [(1 << 20, 1 << 16), (200, 1 << 16), (200, 64)])
def test_forest_finds_the_likely_components(spark, monkeypatch, work, held):
    """Regions that deepen, regions walked in pieces and borders of partitions lose no component."""
    monkeypatch.setattr(neardup, "WORK", work)
    monkeypatch.setattr(neardup, "HELD", held)
    rows = label_rows(np.random.default_rng(work + held), 400, 25)
    packed = [(r[::2] << 4 | r[1::2]).astype(np.uint8).tobytes() for r in rows]
    regions = [[t] * 1 for t in range(neardup.TREES)]
    frame = spark.createDataFrame([(i, [x[0] for x in regions], p) for i, p in enumerate(packed)], "id long, regions array<long>, labels binary").repartition(3)
    found = neardup.forest_links(neardup.first_trees(frame), neardup.DEPTH)
    more = neardup.forest_links(neardup.more_trees(frame), neardup.MORE_DEPTH)
    if work == 200:
        assert found.where("kind = 1").count() > 0
    links = found.where("kind = 0").select("a", "b").union(more.where("kind = 0").select("a", "b"))
    like = (rows[:, None, :] == rows[None, :, :]).sum(axis=2) >= neardup.LIKELY
    got = {r["id"]: r["component"] for r in connected_components(neardup.contracted(links)).collect()}
    want = connected_components(spark.createDataFrame([(int(a), int(b)) for a, b in np.argwhere(like) if a < b], "a long, b long"))
    assert got == {r["id"]: r["component"] for r in want.collect()}


def test_every_tree_has_its_own_order():
    orders = {tuple(o) for o in neardup._ORDERS}
    assert len(orders) == neardup.TREES + neardup.MORE_TREES and all(sorted(o) == list(range(neardup.LABELS)) for o in orders)
