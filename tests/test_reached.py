"""How queries are answered, without their answers: what is moved for it, and that nothing is lost by it."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from prefixlake.functions.digits import high, low
from prefixlake.operators import lookup
from prefixlake.plans import all_queries


def world(spark, seed, digits):
    """Queries, prefixes of ``digits`` digits, ranges from ten numbers to millions, and links, close together."""
    rng = random.Random(seed)
    some = lambda n: "4" + "".join(rng.choice("0012") for _ in range(n - 1))
    queries = [some(rng.randint(4, 11)) for _ in range(600)] * 2 + ["90000000"]
    bins = list(enumerate(some(rng.choice(digits)) for _ in range(400)))
    ranges = [(i, a := int(some(8)), a + rng.choice([0, 9, 99, 1234, 999_999]), rng.choice(["account_range", "issuer_range"])) for i in range(60)]
    links = [(i, j, rng.random() < 0.4) for i, _ in bins for j in range(rng.randint(0, 2))]
    frames = (
        spark.createDataFrame(list(enumerate(queries)), "query_id long, q string"),
        spark.createDataFrame(bins, "id long, bin string").withColumns({"span_low": low(F.col("bin")), "span_high": high(F.col("bin"))}),
        spark.createDataFrame(ranges, "id long, range_low_int int, range_high_int int, range_type string"),
        spark.createDataFrame(links, "bin_id long, institution_id long, is_current boolean"),
    )
    return frames, (queries, bins, ranges, links)


def expected(queries, bins, ranges, links):
    current = {i: any(c for b, _, c in links if b == i) or all(b != i for b, _, _ in links) for i, _ in bins}
    out = Counter()
    for q in queries:
        v, found = int(q[:8].ljust(8, "0")), []
        for i, b in bins:
            if len(b) <= len(q) and q[:8].ljust(8, "0").startswith(b[:8]):
                s = "root_prefix" if len(b) != len(q) else "exact_8_digit" if len(b) >= 8 else "exact_6_digit" if len(b) == 6 else "exact_assigned_bin"
                found.append((-lookup.SPECIFICITY[s], 10 ** max(0, 8 - len(b)), not current[i], b, s, len(b)))
        for _, a, z, t in ranges:
            if a <= v <= z:
                s = "account_range" if t == "account_range" else "broader_range"
                found.append((-lookup.SPECIFICITY[s], z - a + 1, False, q, s, len(q)))
        if found:
            out[min(found)[4:]] += 1
    return out


def got(frames):
    return {(r["strategy"], r["length"]): r["n"] for r in lookup.reached(*frames).collect()}


def test_every_query_is_counted_as_it_is_answered(spark):
    frames, rows = world(spark, 1, range(4, 12))
    assert got(frames) == expected(*rows)


def test_links_decide_between_equally_narrow_prefixes(spark):
    frames, rows = world(spark, 2, [8, 9, 10])
    queries, bins, ranges, links = rows
    assert got(frames) == expected(*rows) != expected(queries, bins, ranges, [])


def test_short_prefixes_alone(spark):
    frames, rows = world(spark, 3, [4, 5, 6, 7, 8])
    assert got(frames) == expected(*rows)


def test_few_rows_a_task(spark, monkeypatch):
    frames, rows = world(spark, 4, [6, 8])
    monkeypatch.setattr(lookup, "EACH", 100)
    assert lookup._parts(*frames[:3]) == 17
    assert got(frames) == expected(*rows)


def test_labels_move_no_links_and_no_heads(spark, sf_dir):
    # The driver's prefixes differ in length only from others with other first digits.
    plan = all_queries.queries()["lookup_match_label"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "_head" not in plan
