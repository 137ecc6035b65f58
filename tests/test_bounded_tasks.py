"""Queries whose rows multiply deal them to tasks by their number, so that a task's share does not grow with the tables."""

from __future__ import annotations

from prefixlake.operators import analytics
from prefixlake.plans import domain


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(analytics, "EACH", 1_000, raising=False)
    links = spark.range(60).selectExpr("id as bin_id", "explode(sequence(id % 50, id % 50 + 20)) as institution_id")
    pairs = analytics.shared_bins(links)
    # 60 sets of 21 holders make 12 600 pairs.
    assert pairs.rdd.getNumPartitions() == 13
    held = [set(range(i % 50, i % 50 + 21)) for i in range(60)]
    want = {(a, b): n for a in range(70) for b in range(a + 1, 70) if (n := sum({a, b} <= h for h in held))}
    assert {(r["a"], r["b"]): r["shared"] for r in pairs.collect()} == want


def test_no_pairs(spark):
    assert analytics.shared_bins(spark.range(3).selectExpr("id as bin_id", "id as institution_id")).count() == 0


def test_portfolios_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(analytics, "EACH", 1_000, raising=False)
    family = spark.range(20).selectExpr("id as root", "explode(sequence(id, id + 4)) as id")
    links = spark.range(1_000).selectExpr("id as bin_id", "explode(array(id % 24, (id + 1) % 24)) as institution_id", "id % 3 = 0 as is_current")
    bins = spark.range(1_000).selectExpr("id", "cast(400000 + id div 2 as string) as bin", "6 as prefix_length", "cast(id % 5 as int) as network_id", "cast(null as int) as country_id")
    held = analytics.portfolio_bins(family, bins, links)
    # Links of institution i: about 83; each counts towards up to five roots.
    fan = [sum(r <= i <= r + 4 for r in range(20)) for i in range(24)]
    rows = sum(fan[b % 24] + fan[(b + 1) % 24] for b in range(1_000))
    assert held.rdd.getNumPartitions() == -(-rows // 1_000)
    want = {}
    for b in range(1_000):
        for i in (b % 24, (b + 1) % 24):
            for root in range(max(0, i - 4), min(19, i) + 1):
                at = (root, str(400000 + b // 2))
                was = want.get(at, (False, 9))
                want[at] = (was[0] or b % 3 == 0, min(was[1], b % 5))
    assert {(r["root"], r["bin"]): (r["is_current"], r["network_id"]) for r in held.collect()} == want


def test_links_are_dealt_by_their_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(domain, "EACH", 500, raising=False)
    links = domain.frame(spark, sf_dir, "bx_links")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert links.rdd.getNumPartitions() == -(-rows // 500)
    monkeypatch.undo()
    assert links.exceptAll(domain.frame(spark, sf_dir, "bx_links")).count() == 0
