"""What ranges move between tasks: pieces by cell, never the blocks that they are laid out as."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.operators.intervals import cut
from prefixlake.plans import all_queries


def test_blocks_are_made_where_they_are_summed(spark):
    ranges = spark.range(50).selectExpr("id * 77 as low", "id * 77 + 1234 as high", "id % 3 as owner")
    held = cut(ranges, "low", "high", ["owner"], {"_n": F.count(F.lit(1))}, {"n": F.sum("_n")})
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Exchange")].count("Generate") == 2


def test_long_ranges_hold_whole_cells(spark):
    rows = [(0, 999, 0), (1_000, 1_999, 0), (500, 1_500, 1), (999, 5_000, 1), (123, 99_999_999, 2), (7_000, 200_000_000, 2), (41_000_000, 41_999_999, 3)]
    ranges = spark.createDataFrame(rows, "low long, high long, owner int")
    held = cut(ranges, "low", "high", ["owner"], {"_n": F.count(F.lit(1))}, {"n": F.sum("_n")})
    got = {(r["start"], r["owner"]): r["n"] for r in held.where("owner is not null").collect()}
    starts = {s for s in {0, *range(0, 10**8, 10_000), *(a for a, _, _ in rows), *(b + 1 for _, b, _ in rows)} if s < 10**8}
    want = {}
    for s in starts:
        for a, b, o in rows:
            if a <= s <= b:
                want[s, o] = want.get((s, o), 0) + 1
    assert got == want


def test_relationships_of_winners_stay_at_their_prefix(spark, sf_dir):
    node = all_queries.queries()["lookup_winner"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "Union" not in node.children().apply(1).toString()
