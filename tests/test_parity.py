"""Every query with an oracle gives the oracle's rows, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from prefixlake.plans import all_queries
from prefixlake.plans.domain import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in (*TABLES, "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return [plain(x) for x in v] if isinstance(v, list) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(all_queries.oracles()))
def test_same_rows(name, spark, sf_dir, duck):
    ours = all_queries.queries()[name](spark, sf_dir)
    theirs = duck.sql(all_queries.oracles()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, [list(r) for r in ours.collect()]) == rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(all_queries.queries()) - set(all_queries.oracles())))
def test_others_run(name, spark, sf_dir):
    assert all_queries.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["lookup_prefix_candidates", "lookup_range_candidates", "lookup_winner", "lookup_more_specific", "portfolio_counts", "shared_bin_pairs"])
def test_no_nested_loops(name, spark, sf_dir):
    plan = all_queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from prefixlake.operators.lookup import range_candidates
    from prefixlake.plans.domain import frame

    found = range_candidates(frame(spark, sf_dir, "bx_queries").where(F.col("query_id") > 900), frame(spark, sf_dir, "bx_ranges"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,900)" in plan
