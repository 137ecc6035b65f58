from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixlake.operators import components


@pytest.mark.parametrize("piece", [1024, 3])
def test_components_against_union_find(spark, monkeypatch, piece):
    monkeypatch.setattr(components, "PIECE", piece)
    rng = np.random.default_rng(piece)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500, 501 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_spread_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(components, "PIECE", 5)
    rows = spark.createDataFrame([(i % 3 if i < 30 else 0, i) for i in range(90)] + [(None, 99)], "k long, v long")
    facts = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    got = components.spread_join(rows, facts, "k", "n", 91, how="left").collect()
    assert sorted(r["v"] for r in got) == sorted([*range(90), 99]) and {r["k"]: r["top"] for r in got} == {0: 89, 1: 28, 2: 29, None: None}
