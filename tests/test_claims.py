"""What a query's claims cost: issuers in linear time, and one fold."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from prefixlake.operators import lookup
from prefixlake.plans import all_queries


def test_claims_are_folded_once(spark, sf_dir):
    plan = all_queries.queries()["lookup_conflicts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_rivals_are_not_made_again_by_a_filter(spark, sf_dir):
    plan = all_queries.queries()["lookup_rivals"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.strip(" +-:").startswith("Filter") and "transform(" in line for line in plan.split("\n"))


def test_many_issuers_are_ordered_in_linear_time(spark):
    one = F.expr("transform(sequence(1L, 30000L), i -> struct(i as id, cast(i % 7 as string) as name, 'issuer' as relationship, i % 3 = 0 as is_primary, i % 5 <> 0 as is_current))")
    rows = spark.range(2).select(one.alias("r"))
    began = time.monotonic()
    got = rows.select(lookup.current_issuers(F.col("r"))["id"].alias("ids")).first()["ids"]
    assert time.monotonic() - began < 15
    assert got == sorted((i for i in range(1, 30001) if i % 5), key=lambda i: (i % 3 != 0, str(i % 7), i))


def test_an_issuer_named_twice_counts_once(spark):
    rows = [(1, "b", "issuer", True, True), (1, "b", "program_issuer", False, True), (2, "a", "issuer", False, True)]
    df = spark.createDataFrame([(rows,)], "r array<struct<id:long,name:string,relationship:string,is_primary:boolean,is_current:boolean>>")
    assert [r["relationship"] for r in df.select(lookup.current_issuers(F.col("r")).alias("x")).first()["x"]] == ["issuer", "issuer"]
