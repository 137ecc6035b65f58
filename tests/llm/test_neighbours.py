from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixlake.llm import neighbours


def test_recall_copies_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "CELL", 100)  # top leaves are split in the executors
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    points = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.3).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies of one vector, some of them queries
    repeated = rows[:3]
    odd = [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None] * 4), (2400, [1.0] * 3), (2500, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame(rows + odd + repeated, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0).toPandas()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    queries = [i for i in ids if i % 100 == 0]
    assert sorted(got.query_id.unique()) == queries
    found = 0
    for q in queries:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and [d[ids == v][0] for v in own.vec_id] == list(own.score)
        assert sorted(zip(own.score, own.vec_id, strict=True)) == list(zip(own.score, own.vec_id, strict=True))
        found += len(set(want) & set(own.vec_id))
    assert found >= 0.9 * 10 * len(queries)
    assert list(got[got.query_id == 1000].sort_values("rank").vec_id) == [0, *range(1001, 1010)]


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") == 0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, n))


def test_ties_go_to_the_smaller_ids(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(40)]) for i in range(40)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") == 0).toPandas().sort_values("rank")
    assert list(got.vec_id) == list(range(1, 11)) and got.score.nunique() == 1


@pytest.mark.parametrize(("shift", "spread"), [(1e8, 1.0), (0.0, 1.0), (-3e5, 1e-3)])
def test_recall_far_from_the_origin_and_without_clusters(spark, monkeypatch, shift, spread):
    monkeypatch.setattr(neighbours, "LEAF", 12)
    x = shift + spread * np.random.default_rng(4).normal(size=(1200, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 10 == 0).toPandas()
    found = 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = own.sort_values("rank")
        assert list(own.score) == list(d[own.vec_id])
        found += len(set(np.argsort(d, kind="stable")[:10]) & set(own.vec_id))
    assert found >= 0.9 * 10 * 120 and got.measured_recall.iloc[0] >= 0.85


def test_graft_keeps_every_leaf_reachable():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    tree = neighbours.fit_tree(x, leaf=60)
    leaf = tree.place(x)
    parts = {n: neighbours.fit_tree(x[leaf == n], leaf=8) for n in range(0, tree.leaves, 2)}
    grown = neighbours.graft(tree, parts)
    assert sorted(grown.visits(x[0])) == list(range(grown.leaves)) and grown.leaves > tree.leaves
    assert next(iter(grown.visits(x[0]))) == grown.place(x[:1])[0] or len(set(grown.place(x))) > tree.leaves


def test_queries_move_once_to_a_piece_not_once_to_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 12)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(2000, 12)))], "vec_id long, embedding array<double>")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    known = set(stages())
    assert neighbours.nearest(df, F.lit(True)).count() == 20_000
    assert max(n for s, n in stages().items() if s not in known) <= 8 * 2000


def test_bins_and_pieces_hold_every_leaf_and_stay_small(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    points = np.array([3, 0, 400, 8, 9, 0, 12, 51, 1, 30])
    bins = neighbours.deal(points, 2 * points, 100, gather=20)
    held = np.zeros(len(bins.piece), int)
    for leaf, n in enumerate(points):
        for i in range(bins.many[leaf]):
            held[bins.first[leaf] + i] += -(-n // bins.many[leaf])
    assert held.max() <= 51 and list(bins.like[bins.first]) == list(bins.first) and (np.diff(bins.piece) >= 0).all() and bins.piece[-1] == bins.pieces - 1
    assert np.bincount(bins.piece, held).max() <= 102


def test_vectors_closer_together_than_rounding_can_tell():
    rng = np.random.default_rng(7)
    points = 1e6 + np.round(rng.normal(size=(300, 6)) * 4) * 2.0**-33
    found = neighbours.Found(20, 11)
    for at in range(0, 300, 100):
        q, p, d = neighbours.closest(points[:20], points[at : at + 100], points[:20] - 5.0, points[at : at + 100] - 5.0, 11, found.bound)
        found.add(q, d, at + p)
    for i in range(20):
        d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        want = np.lexsort((np.arange(300), d))[:11]
        assert list(found.ids[i]) == list(want) and list(found.d[i]) == list(d[want])
