"""Lookup behaviour on a small hand-made world."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from prefixlake.functions.digits import high, low
from prefixlake.operators import lookup
from prefixlake.operators.joins import prefix_join, range_join

INSTITUTIONS = {1: "Harborview", 2: "Meridian", 3: "Cascade", 4: "Northshore", 5: "Cascade Retail", 6: "Pacific"}
BINS = {1: "510001", 2: "520001", 3: "410000", 4: "41000012", 5: "41000034", 6: "530001", 7: "600001", 8: "4147201299"}
LINKS = [
    (1, 1, "issuer", True, True, 95, "2020-01-01"),
    (2, 2, "issuer", True, True, 95, "2020-01-01"),
    (2, 6, "issuer", True, True, 85, "2020-01-01"),
    (3, 3, "issuer", True, True, 80, "2020-01-01"),
    (4, 4, "issuer", True, True, 95, "2020-01-01"),
    (5, 5, "issuer", True, True, 95, "2020-01-01"),
    (6, 3, "former_issuer", False, False, 90, "2020-01-01"),
    (6, 2, "issuer", True, True, 90, "2024-01-01"),
    (8, 2, "issuer", True, True, 90, "2024-01-01"),
]
RANGES = [(1, 45000000, 45009999, "issuer_range", 6), (2, 45000050, 45000059, "account_range", 1)]


@pytest.fixture(scope="module")
def answers(spark):
    def ask(*queries):
        inst = spark.createDataFrame(list(INSTITUTIONS.items()), "id long, display_name string")
        bins = spark.createDataFrame(list(BINS.items()), "id long, bin string").withColumns({"span_low": low(F.col("bin")), "span_high": high(F.col("bin"))})
        links = spark.createDataFrame([(*x[:6], dt.datetime.fromisoformat(x[6])) for x in LINKS], "bin_id long, institution_id long, relationship_type string, is_current boolean, is_primary boolean, confidence_pct int, effective_from timestamp").withColumn("effective_to", F.lit(None).cast("timestamp"))
        ranges = spark.createDataFrame(RANGES, "id long, range_low_int int, range_high_int int, range_type string, institution_id long")
        ranges = ranges.selectExpr("*", "true as is_current", "cast(null as timestamp) as effective_from", "cast(null as timestamp) as effective_to", "cast(null as int) as confidence_pct")
        asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, q string")
        return {r["q"]: r for r in lookup.resolve(asked, bins, ranges, links, inst).collect()}

    return ask


def names(row):
    return [r["name"] for r in row["relationships"]]


def test_plain_exact(answers):
    r = answers("510001")["510001"]
    assert (r["strategy"], names(r), r["level"]) == ("exact_6_digit", ["Harborview"], "verified")


def test_longer_prefix_beats_root_and_never_answers_for_it(answers):
    got = answers("41000012", "41000099", "410000")
    assert names(got["41000012"]) == ["Northshore"] and got["41000012"]["strategy"] == "exact_8_digit" and got["41000012"]["others"] == 1
    assert names(got["41000099"]) == ["Cascade"] and got["41000099"]["strategy"] == "root_prefix"
    assert names(got["410000"]) == ["Cascade"]


def test_narrow_range_wins_and_the_broad_one_is_kept(answers):
    got = answers("45000055", "45000099")
    assert names(got["45000055"]) == ["Harborview"] and got["45000055"]["strategy"] == "account_range" and got["45000055"]["others"] == 1
    assert names(got["45000099"]) == ["Pacific"] and got["45000099"]["strategy"] == "broader_range"


def test_succession_is_no_conflict(answers):
    r = answers("530001")["530001"]
    assert names(r) == ["Meridian", "Cascade"] and r["conflicts"] == 0 and r["level"] == "high"


def test_rival_issuers_stay_contested(answers):
    r = answers("520001")["520001"]
    assert r["level"] == "conflicted" and r["conflicts"] == 1 and set(names(r)) == {"Meridian", "Pacific"} and r["resolution"] == "unresolved"


def test_found_without_issuer_and_not_found(answers):
    got = answers("600001", "999999")
    assert got["600001"]["level"] == "unknown" and got["600001"]["kind"] == "prefix" and "999999" not in got


def test_prefixes_above_eight_digits_share_their_eight(answers):
    assert answers("4147201211")["4147201211"]["strategy"] == "exact_8_digit"


def test_joins_equal_theta(spark):
    import random

    rnd = random.Random(4)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    qs = [(i, "41" + digits(rnd.randint(2, 9))) for i in range(200)]
    ps = [(i, "41" + digits(rnd.randint(2, 9))) for i in range(200)] + [(200 + i, q[: rnd.randint(4, len(q))]) for i, q in qs if len(q) > 4]
    found = prefix_join(spark.createDataFrame(qs, "query_id long, q string"), spark.createDataFrame(ps, "id long, bin string")).select("query_id", "id").collect()
    span = lambda p: (int(p[:8].ljust(8, "0")), int(p[:8].ljust(8, "9")))
    assert sorted(map(tuple, found)) == sorted((i, j) for i, q in qs for j, p in ps if span(p)[0] <= span(q)[0] <= span(p)[1] and len(p) <= len(q))
    vs = [(i, rnd.randint(0, 5000)) for i in range(150)]
    rs = [(i, a := rnd.randint(0, 5000), a + rnd.choice([0, 9, 10, 99, 700])) for i in range(150)]
    found = range_join(spark.createDataFrame(vs, "k long, v long"), spark.createDataFrame(rs, "id long, lo long, hi long"), F.col("v"), "lo", "hi").select("k", "id").collect()
    assert sorted(map(tuple, found)) == sorted((k, i) for k, v in vs for i, lo, hi in rs if lo <= v <= hi)
