"""Elementary intervals against every range tried on every value."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from prefixlake.operators.intervals import above, blocks, cut, locate


def world(spark, seed, n, widest):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        low = rnd.choice([rnd.randrange(10**8), 40_000_000 + rnd.randrange(3000)])
        rows.append((i, low, min(10**8 - 1, low + rnd.choice([0, 9, 99, rnd.randrange(widest)])), i % 4))
    rows += [(n, 0, 10**8 - 1, 0), (n + 1, 77, 70, 1), (n + 2, 10**8 - 1, 10**8 - 1, 2), (n + 3, None, 5, 2), (n + 4, *rows[0][1:])]
    return rows, spark.createDataFrame(rows, "id long, low int, high int, owner int")


def test_blocks_make_up_the_range_and_hold_their_values(spark):
    rows, ranges = world(spark, 1, 60, 2_000_000)
    got = ranges.where("low <= high").select("low", "high", blocks(F.col("low"), F.col("high")).alias("b")).collect()
    for r in got:
        spans = sorted((k % 10**9 * 10 ** (k // 10**9), (k % 10**9 + 1) * 10 ** (k // 10**9)) for k in r["b"])
        assert spans[0][0] == r["low"] and spans[-1][1] == r["high"] + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905
        assert len(spans) <= 18 * 9
    keys = spark.range(1).select(above(F.lit(12345678)).alias("k")).first()["k"]
    assert [k % 10**9 for k in keys] == [12345678 // 10**k for k in range(9)]


def test_values_learn_what_holds(spark):
    rows, ranges = world(spark, 2, 300, 5000)
    found = cut(ranges, "low", "high", [], {"_n": F.count(F.lit(1)), "_first": F.min("id")}, {"n": F.coalesce(F.sum("_n"), F.lit(0)), "first": F.min("_first")})
    rnd = random.Random(3)
    values = sorted({0, 10**8 - 1, *(v for _, low, high, _ in rows if low is not None for v in (low, high, max(0, low - 1), min(10**8 - 1, high + 1))), *(rnd.randrange(10**8) for _ in range(200))})
    asked = spark.createDataFrame([(v,) for v in values], "value long")
    got = {r["value"]: (r["n"], r["first"]) for r in locate(asked, "value", found).collect()}
    for v in values:
        holding = [i for i, low, high, _ in rows if low is not None and low <= v <= high]
        assert got[v] == (len(holding), min(holding))


def test_grouped_by_owner_and_no_ranges(spark):
    rows, ranges = world(spark, 4, 100, 800)
    held = cut(ranges, "low", "high", ["owner"], {"_n": F.count(F.lit(1))}, {"n": F.sum("_n")})
    total = {(r["start"], r["owner"]): r["n"] for r in held.collect()}
    for (start, owner), n in list(total.items())[:400]:
        assert n == sum(1 for _, low, high, o in rows if low is not None and low <= start <= high and o == owner)
    none = cut(ranges.limit(0), "low", "high", [], {"_n": F.count(F.lit(1))}, {"n": F.coalesce(F.sum("_n"), F.lit(0))})
    assert none.agg(F.sum("n"), F.count(F.lit(1))).first()[:] == (0, 10_000)
    assert locate(spark.createDataFrame([(5,)], "value long"), "value", none).first()["n"] == 0
