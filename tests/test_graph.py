"""Graph expansion: levels, cycles, depth, and a plan that does not grow with it."""

from __future__ import annotations

from prefixlake.operators.joins import expand_graph
from prefixlake.plans import all_queries


def reach(roots, edges, depth):
    out = {}
    for r in roots:
        seen, level = {r: 0}, 0
        frontier = [r]
        while frontier and (depth is None or level < depth):
            level += 1
            frontier = [c for p, c in edges if p in frontier and c not in seen]
            seen |= dict.fromkeys(frontier, level)
        out |= {(r, n): k for n, k in seen.items()}
    return out


def test_levels_and_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (2, 4), (9, 9), (1, 2), (None, 3)]
    df = spark.createDataFrame(edges, "parent long, child long")
    roots = spark.createDataFrame([(r,) for r in (1, 3, 9, 10, 1)], "root long")
    for depth in (0, 1, 4, None):
        got = expand_graph(roots, df, depth).collect()
        assert {(r["root"], r["id"]): r["level"] for r in got} == reach([1, 3, 9, 10], edges, depth) and len(got) == len({(r["root"], r["id"]) for r in got})
    assert expand_graph(roots.limit(0), df).count() == 0


def test_plan_stays_small(spark, sf_dir):
    plan = all_queries.queries()["portfolio_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") < 30
