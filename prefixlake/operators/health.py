"""Database health: seven weighted checks, their mean and its grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.operators.analytics import duplicate_groups, orphans, ratio_score

# What each check weighs, and how large a share of faults takes all its score.
WEIGHTS = {"integrity": 3.0, "indexes": 2.0, "duplicates": 1.0, "orphans": 1.0, "conflicts": 0.6, "relationships": 1.5, "completeness": 1.0}
TOLERANCES = {"duplicates": 0.001, "orphans": 0.002, "conflicts": 0.02}
GRADES = (("excellent", 0.95), ("good", 0.85), ("fair", 0.70))
#: What lookups and searches need of a release; this is what indexes are to a database file.
EXPECTED = {
    "bins": ("id", "bin", "prefix_length", "span_low", "span_high", "network_id", "country_id", "card_type", "funding_type", "status"),
    "institutions": ("id", "uid", "display_name", "normalized_name", "country_id"),
    "links": ("bin_id", "institution_id", "relationship_type", "is_current", "is_primary"),
    "ranges": ("id", "range_low_int", "range_high_int", "range_type", "institution_id"),
}


def grade(score: Column) -> Column:
    """Excellent, good, fair or poor."""
    out = F.lit("poor")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def health(tables: dict[str, DataFrame], open_conflicts: DataFrame, intact: bool, expected: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(key, score, weight, count, grade, passed) of each check, and of ``overall``, their weighted mean.

    ``tables`` has bins (with currency_code), institutions, links, addresses, aliases and ranges;
    ``open_conflicts`` is one row with the number of conflicts nobody has settled; ``intact`` says whether
    the release verifies. Every table is read once for counts and once for what is missing.
    """
    bins, inst, links = tables["bins"], tables["institutions"], tables["links"]
    count = F.count(F.lit(1))
    filled = F.count("network_id") + F.count("country_id") + F.count_if(F.col("card_type") != "unknown") + F.count_if(F.col("funding_type") != "unknown") + F.count("currency_code")
    one = bins.agg(count.alias("records"), filled.alias("filled"))
    parts = [
        duplicate_groups(bins, "bin").agg(count.alias("dup_bins")),
        duplicate_groups(tables["aliases"], "institution_id", "normalized_alias").agg(count.alias("dup_aliases")),
        orphans(links, "bin_id", bins).agg(count.alias("o_bins")),
        links.agg(F.countDistinct("bin_id").alias("linked")),
        open_conflicts.toDF("open"),
        *[orphans(tables[t], "institution_id", inst).agg(count.alias(f"o_{t}")) for t in ("links", "addresses", "aliases", "ranges")],
    ]
    for part in parts:
        one = one.join(F.broadcast(part))  # one row each
    wanted = EXPECTED if expected is None else expected
    absent = sum(c not in tables[t].columns for t, names in wanted.items() for c in names)
    records, all_of = F.col("records"), max(1, sum(map(len, wanted.values())))
    lost = F.col("o_bins") + F.col("o_links") + F.col("o_addresses") + F.col("o_aliases") + F.col("o_ranges")
    twice = F.col("dup_bins") + F.col("dup_aliases")
    checks = {
        "integrity": (F.lit(1.0 if intact else 0.0), F.lit(0)),
        "indexes": (F.lit(max(0.0, 1.0 - absent / all_of)), F.lit(absent)),
        "duplicates": (ratio_score(twice, records, TOLERANCES["duplicates"]), twice),
        "orphans": (ratio_score(lost, F.greatest(records, F.lit(1)), TOLERANCES["orphans"]), lost),
        "conflicts": (ratio_score(F.col("open"), F.greatest(records, F.lit(1)), TOLERANCES["conflicts"]), F.col("open")),
        "relationships": (F.when(records > 0, F.col("linked") / records).otherwise(0.0), F.greatest(F.lit(0), records - F.col("linked"))),
        "completeness": (F.when(records > 0, F.col("filled") / 5.0 / records).otherwise(0.0), 5 * records - F.col("filled")),
    }
    mean = sum((s * WEIGHTS[k] for k, (s, _) in checks.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    checks["overall"] = (mean, F.lit(None))
    rows = F.array(*[F.struct(F.lit(k).alias("key"), s.cast("double").alias("score"), F.lit(WEIGHTS.get(k, sum(WEIGHTS.values()))).alias("weight"), n.cast("bigint").alias("count")) for k, (s, n) in checks.items()])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumns({"grade": grade(F.col("score")), "passed": F.col("score") >= 0.85})
