"""Analytics, portfolio, quality and health queries with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.operators import analytics as an
from prefixlake.operators import health, search
from prefixlake.plans.domain import frame, oracle
from prefixlake.plans.registry import query
from prefixlake.session import shared_folder
from prefixlake.sources.release import Releases


@query(
    "analytics_totals",
    oracle("""select (select count(*) from bx_bins) as bins, (select count(distinct country_id) from bx_bins) as countries, (select count(distinct network_id) from bx_bins) as networks,
    (select count(*) from bx_institutions) as institutions, (select count(*) from bx_ranges) as ranges, (select count(*) from bx_addresses) as addresses"""),
)
def analytics_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals."""
    return an.database_stats(*(frame(spark, sf_dir, n) for n in ("bx_bins", "bx_institutions", "bx_ranges", "bx_addresses")))


def _distribution(column: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return an.with_share(an.distribution(frame(spark, sf_dir, "bx_bins"), F.col(column)))

    build.__doc__ = f"A4, A8, A10: prefixes by {column}."
    query(
        f"analytics_{column}",
        oracle(f"""with d as (select {column} as key, count(*) as value from bx_bins where {column} is not null and {column} not in ('', 'unknown') group by 1)
        select key, value, cast(value * 1000000 // (select sum(value) from d) as bigint) as share_ppm from d"""),
    )(build)


for _c in ("card_type", "funding_type", "status"):
    _distribution(_c)


@query("analytics_country", oracle("select c.name as key, count(*) as value from bx_bins b join bx_countries c on c.id = b.country_id group by 1"))
def analytics_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes by country."""
    land = frame(spark, sf_dir, "bx_countries").select(F.col("id").alias("country_id"), "name")
    return an.distribution(frame(spark, sf_dir, "bx_bins").join(land, "country_id"), F.col("name"))


@query("analytics_network", oracle("select n.display_name as key, count(*) as value from bx_bins b join bx_networks n on n.id = b.network_id group by 1"))
def analytics_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes by network."""
    net = frame(spark, sf_dir, "bx_networks").select(F.col("id").alias("network_id"), "display_name")
    return an.distribution(frame(spark, sf_dir, "bx_bins").join(net, "network_id"), F.col("display_name"))


@query(
    "analytics_region",
    oracle("""with fa as (select institution_id, arg_min(region, id) as region from bx_addresses group by 1)
    select fa.region as key, count(*) as value from bx_bins b join bx_links l on l.bin_id = b.id and l.is_primary join fa on fa.institution_id = l.institution_id group by 1"""),
)
def analytics_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary links by the region of the institution's first address; a prefix with two links counts twice."""
    bins, links, addresses = (frame(spark, sf_dir, n) for n in ("bx_bins", "bx_links", "bx_addresses"))
    own = links.where("is_primary").join(bins.select(F.col("id").alias("bin_id")), "bin_id", "left_semi")
    return an.distribution(own.join(search.first_addresses(addresses), F.col("institution_id") == F.col("inst_id")), F.col("region"))


@query("top_countries", oracle("select c.name as key, count(*) as value from bx_bins b join bx_countries c on c.id = b.country_id group by 1 order by value desc, key limit 8"))
def top_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the eight largest countries."""
    return analytics_country(spark, sf_dir).orderBy(F.desc("value"), "key").limit(8)


@query(
    "analytics_top_n_other",
    oracle("""with d as (select c.name as key, count(*) as value, row_number() over (order by count(*) desc, c.name) as rn from bx_bins b join bx_countries c on c.id = b.country_id group by 1)
    select case when rn <= 10 then key else '__other__' end as key, cast(sum(value) as bigint) as value from d group by 1"""),
)
def analytics_top_n_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten countries and the rest."""
    return an.top_with_other(analytics_country(spark, sf_dir))


@query(
    "analytics_growth",
    oracle("""with m as (select strftime(first_seen, '%Y-%m') as period, count(*) as added from bx_bins group by 1), w as (select * from m order by period desc limit 6)
    select period, added, cast(sum(added) over (order by period) as bigint) as cumulative from w"""),
)
def analytics_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes first seen per month, the last six months."""
    return an.growth(frame(spark, sf_dir, "bx_bins"), 6)


@query("analytics_top_institutions", oracle("select i.display_name, count(*) as links from bx_links l join bx_institutions i on i.id = l.institution_id group by 1 order by links desc, display_name limit 12"))
def analytics_top_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions by links."""
    return an.top_institutions(frame(spark, sf_dir, "bx_links"), frame(spark, sf_dir, "bx_institutions")).select("display_name", "links")


@query(
    "institution_stats",
    oracle("""select l.institution_id, count(*) as bins, count(*) filter (card_type = 'credit') as credit, count(*) filter (card_type = 'debit') as debit, count(*) filter (is_prepaid) as prepaid,
    count(*) filter (is_commercial) as commercial, count(distinct country_id) as countries from (select distinct institution_id, bin_id from bx_links) l join bx_bins b on b.id = l.bin_id group by 1"""),
)
def institution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every institution's prefixes in figures."""
    return an.institution_stats(frame(spark, sf_dir, "bx_bins"), frame(spark, sf_dir, "bx_links"))


_FAMILY = """
  step as (select institution_id as parent, related_institution_id as child from bx_edges where relationship_type in ('subsidiary', 'predecessor', 'brand_of') union select parent_id, id from bx_institutions where parent_id is not null),
  walk as (select id as root, id, 0 as level from bx_institutions union select w.root, s.child, w.level + 1 from walk w join step s on s.parent = w.id where w.level < 4),
  family as (select distinct root, id from walk),
  held as (select f.root, b.bin, bool_or(l.is_current) as is_current, min(b.prefix_length) as prefix_length from family f join bx_links l on l.institution_id = f.id join bx_bins b on b.id = l.bin_id group by 1, 2)"""


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    inst = frame(spark, sf_dir, "bx_institutions")
    return an.contributing(inst, frame(spark, sf_dir, "bx_edges"), inst.select(F.col("id").alias("root")))


@query("portfolio_family", oracle(f"with recursive {_FAMILY} select root, id from family"))
def portfolio_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which institutions count towards each portfolio."""
    return _family(spark, sf_dir)


@query(
    "portfolio_counts",
    oracle(f"""with recursive {_FAMILY} select root, count(*) as total, count(*) filter (is_current) as current, count(*) filter (not is_current) as historical, count(*) filter (prefix_length < 8) as roots, count(*) filter (prefix_length >= 8) as extended from held group by root"""),
)
def portfolio_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every portfolio in figures."""
    return an.portfolio_counts(an.portfolio_bins(_family(spark, sf_dir), frame(spark, sf_dir, "bx_bins"), frame(spark, sf_dir, "bx_links")))


@query("portfolio_by_length", oracle(f"with recursive {_FAMILY} select root, cast(prefix_length as varchar) || '-digit' as label, count(*) as bins from held group by root, prefix_length"))
def portfolio_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every portfolio by prefix length."""
    held = an.portfolio_bins(_family(spark, sf_dir), frame(spark, sf_dir, "bx_bins"), frame(spark, sf_dir, "bx_links"))
    return held.groupBy("root", F.concat(F.col("prefix_length").cast("string"), F.lit("-digit")).alias("label")).agg(F.count(F.lit(1)).alias("bins"))


_QUALITY = """
  b as (select count(*) as bins, count(*) filter (prefix_length >= 8) as extended, count(*) filter (prefix_length = 6) as roots, count(country_id) as countries, count(network_id) as networks from bx_bins),
  l as (select count(distinct bin_id) as linked, count(distinct bin_id) filter (is_current) as current from bx_links),
  r as (select count(*) as ranges, count(*) filter (range_type = 'account_range') as account from bx_ranges),
  d as (select (select count(*) from (select 1 from bx_bins group by bin, prefix_length having count(*) > 1)) as dup_bins, (select count(*) from (select 1 from bx_institutions group by normalized_name, country_id having count(*) > 1)) as dup_inst, (select count(*) from bx_institutions) as institutions)"""


@query(
    "quality_metrics",
    oracle(f"""with {_QUALITY}
    select 'institution_resolution' as key, current as numerator, bins as denominator from b, l union all select 'extended_coverage', extended, bins from b union all select 'root_coverage', roots, bins from b
    union all select 'country_coverage', countries, bins from b union all select 'network_coverage', networks, bins from b union all select 'current_coverage', current, linked from l
    union all select 'range_coverage', account, ranges from r union all select 'duplicate_rate', dup_bins, bins from b, d union all select 'duplicate_institution_rate', dup_inst, institutions from d
    union all select 'conflict_rate', 0, bins from b union all select 'missing_institution_rate', greatest(0, bins - current), bins from b, l union all select 'missing_country_rate', bins - countries, bins from b"""),
)
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve metrics."""
    return an.quality_metrics(*(frame(spark, sf_dir, n) for n in ("bx_bins", "bx_links", "bx_ranges", "bx_institutions")))


@query(
    "orphans",
    oracle("""with kept as (select id from bx_institutions where id % 9 <> 0)
    select 'links' as child, count(*) as orphans from bx_links where institution_id not in (select id from kept)
    union all select 'addresses', count(*) from bx_addresses where institution_id not in (select id from kept)
    union all select 'ranges', count(*) from bx_ranges where institution_id not in (select id from kept)
    union all select 'claims', count(*) from bx_claims where bin_id not in (select id from bx_bins)"""),
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose parent is gone."""
    kept = frame(spark, sf_dir, "bx_institutions").where("id % 9 <> 0")
    out = []
    for name, view in (("links", "bx_links"), ("addresses", "bx_addresses"), ("ranges", "bx_ranges")):
        out.append(an.orphans(frame(spark, sf_dir, view), "institution_id", kept).agg(F.lit(name).alias("child"), F.count(F.lit(1)).alias("orphans")))
    out.append(an.orphans(frame(spark, sf_dir, "bx_claims"), "bin_id", frame(spark, sf_dir, "bx_bins")).agg(F.lit("claims").alias("child"), F.count(F.lit(1)).alias("orphans")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query(
    "health_checks",
    oracle("""with al as (select id as institution_id, normalized_name as normalized_alias from bx_institutions union all select id + 3, normalized_name from bx_institutions where id % 5 = 0),
    t as (select count(*) as records, count(network_id) + count(b.country_id) + count(*) filter (card_type <> 'unknown') + count(*) filter (funding_type <> 'unknown') + count(c.currency_code) as filled from bx_bins b left join bx_countries c on c.id = b.country_id),
    d as (select (select count(*) from (select 1 from bx_bins group by bin having count(*) > 1)) + (select count(*) from (select 1 from al group by institution_id, normalized_alias having count(*) > 1)) as dup),
    o as (select (select count(*) from bx_links where bin_id not in (select id from bx_bins)) + (select count(*) from bx_links where institution_id not in (select id from bx_institutions))
      + (select count(*) from bx_addresses where institution_id not in (select id from bx_institutions)) + (select count(*) from al where institution_id not in (select id from bx_institutions))
      + (select count(*) from bx_ranges where institution_id not in (select id from bx_institutions)) as lost),
    l as (select count(distinct bin_id) as linked from bx_links), x as (select count(*) as opened from bx_staging where status = 'conflicted'),
    c as (
      select 'integrity' as key, 1.0e0 as score, 3.0e0 as weight, 0 as count union all select 'indexes', 1.0e0, 2.0e0, 0
      union all select 'duplicates', case when dup = 0 then 1 else greatest(0, 1 - dup / records / 0.001e0) end, 1.0e0, dup from t, d
      union all select 'orphans', case when lost = 0 then 1 else greatest(0, 1 - lost / records / 0.002e0) end, 1.0e0, lost from t, o
      union all select 'conflicts', case when opened = 0 then 1 else greatest(0, 1 - opened / records / 0.02e0) end, 0.6e0, opened from t, x
      union all select 'relationships', linked / records, 1.5e0, greatest(0, records - linked) from t, l
      union all select 'completeness', filled / 5e0 / records, 1.0e0, 5 * records - filled from t),
    w as (select * from c union all select 'overall', sum(score * weight) / 10.1e0, 10.1e0, null from c)
    select key, cast(round(score * 1000000) as bigint) as score_ppm, cast(round(weight * 10) as bigint) as weight_tenths, cast(count as bigint) as count,
           case when score >= 0.95 then 'excellent' when score >= 0.85 then 'good' when score >= 0.70 then 'fair' else 'poor' end as grade, score >= 0.85 as passed from w"""),
)
def health_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven checks of a release, written and verified, with their weighted mean and grades."""
    bins, inst, land = (frame(spark, sf_dir, n) for n in ("bx_bins", "bx_institutions", "bx_countries"))
    aliases = inst.select(F.col("id").alias("institution_id"), F.col("normalized_name").alias("normalized_alias"))
    aliases = aliases.unionByName(inst.where("id % 5 = 0").select((F.col("id") + 3).alias("institution_id"), F.col("normalized_name").alias("normalized_alias")))
    made = bins.join(land.select(F.col("id").alias("country_id"), "currency_code"), "country_id", "left")
    held = Releases(spark, f"{shared_folder(spark)}/health-{uuid.uuid4().hex}")
    held.write("1", {"bins": made, "institutions": inst, "links": frame(spark, sf_dir, "bx_links"), "addresses": frame(spark, sf_dir, "bx_addresses"), "aliases": aliases, "ranges": frame(spark, sf_dir, "bx_ranges")})
    opened = frame(spark, sf_dir, "bx_staging").where("status = 'conflicted'").agg(F.count(F.lit(1)))
    rows = health.health(held.tables("1"), opened, held.verify("1"))
    return rows.select("key", F.round(F.col("score") * 1000000).cast("bigint").alias("score_ppm"), F.round(F.col("weight") * 10).cast("bigint").alias("weight_tenths"), "count", "grade", "passed")


@query(
    "contested_ranges",
    oracle("""select range_low_int, range_high_int, count(distinct institution_id) as claimants, string_agg(distinct display_name, '|' order by display_name) as names
    from bx_ranges r join bx_institutions i on i.id = r.institution_id group by 1, 2 having count(distinct institution_id) > 1"""),
)
def contested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges with several claimants."""
    return an.contested_ranges(frame(spark, sf_dir, "bx_ranges"), frame(spark, sf_dir, "bx_institutions"))


@query("shared_bin_pairs", oracle("select a.institution_id as a, b.institution_id as b, count(distinct a.bin_id) as shared from bx_links a join bx_links b on a.bin_id = b.bin_id and a.institution_id < b.institution_id group by 1, 2"))
def shared_bin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions with prefixes in common."""
    return an.shared_bins(frame(spark, sf_dir, "bx_links"))


@query("duplicate_bins", oracle("select bin, count(*) as n from bx_bins group by bin, prefix_length having count(*) > 1"))
def duplicate_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes recorded twice."""
    return an.duplicate_groups(frame(spark, sf_dir, "bx_bins"), "bin", "prefix_length").select("bin", "n")


@query("staging_status", oracle("select batch_id, status, count(*) as records from bx_staging group by 1, 2"))
def staging_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged records by status."""
    return an.status_counts(frame(spark, sf_dir, "bx_staging"))


@query(
    "analytics_snapshot",
    oracle("""with s as (select * from bx_bins where status = 'active')
    select 'bins' as metric, count(*) as value from s union all select 'countries', count(distinct country_id) from s union all select 'networks', count(distinct network_id) from s
    union all select 'credit', count(*) from s where card_type = 'credit' union all select 'debit', count(*) from s where card_type = 'debit' union all select 'charge', count(*) from s where card_type = 'charge'
    union all select 'prepaid', count(*) from s where is_prepaid union all select 'commercial', count(*) from s where is_commercial
    union all select 'institutions', count(distinct institution_id) from bx_links where bin_id in (select id from s) union all select 'all_institutions', count(*) from bx_institutions union all select 'ranges', count(*) from bx_ranges"""),
)
def analytics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline figures of the active prefixes."""
    bins = frame(spark, sf_dir, "bx_bins").where("status = 'active'")
    return an.snapshot(bins, *(frame(spark, sf_dir, n) for n in ("bx_links", "bx_institutions", "bx_ranges")))


@query("delete_orphans", oracle("select id, institution_id from bx_addresses where institution_id in (select id from bx_institutions where id % 9 <> 0)"))
def delete_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses whose institution is still there."""
    kept = frame(spark, sf_dir, "bx_institutions").where("id % 9 <> 0")
    return an.without_orphans(frame(spark, sf_dir, "bx_addresses"), "institution_id", kept).select("id", "institution_id")
