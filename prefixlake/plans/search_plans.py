"""Search queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.operators import search
from prefixlake.operators.search import AdvancedQuery, TableFilters
from prefixlake.plans.domain import frame, oracle
from prefixlake.plans.registry import query

_ROWS = """
  pl as (select bin_id, min(institution_id) as inst_id, bool_or(is_current) as is_current, min(relationship_type) as relationship_type from bx_links where is_primary group by bin_id),
  fa as (select institution_id, arg_min(region, id) as region, arg_min(city, id) as city from bx_addresses group by institution_id),
  bin_rows as (
    select b.id, b.bin, b.prefix_length, n.code as network_code, c.iso2 as country_code, c.name as country, b.card_type, b.funding_type, b.is_prepaid, b.is_commercial, b.status, b.first_seen, b.span_low,
           i.display_name as institution, pl.relationship_type, coalesce(pl.is_current, true) as is_current, fa.region, fa.city
    from bx_bins b left join bx_networks n on n.id = b.network_id left join bx_countries c on c.id = b.country_id left join pl on pl.bin_id = b.id
      left join bx_institutions i on i.id = pl.inst_id left join fa on fa.institution_id = i.id)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rows(*(frame(spark, sf_dir, n) for n in ("bx_bins", "bx_networks", "bx_countries", "bx_links", "bx_institutions", "bx_addresses")))


def _search(name: str, criteria: AdvancedQuery | TableFilters, condition: str, doc: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.where_all(_rows(spark, sf_dir), criteria.conditions()).select("bin", "network_code", "country_code", "card_type", "institution", "is_current")

    build.__doc__ = doc
    query(name, oracle(f"with {_ROWS} select bin, network_code, country_code, card_type, institution, is_current from bin_rows where {condition}"))(build)


_search("search_by_prefix", AdvancedQuery(bin_prefix="40001"), "bin like '40001%'", "P7: prefixes below a few digits.")
_search("search_by_range", AdvancedQuery(bin_from="400050", bin_to="400120"), "span_low between 40005000 and 40012099", "P8: prefixes between two values.")
_search("search_attributes", AdvancedQuery(card_type="debit", status="active", prepaid=False), "card_type = 'debit' and status = 'active' and is_prepaid is not null and not is_prepaid", "P9: attribute criteria; unknown is not false.")
_search("search_geography", AdvancedQuery(country_code="bx", region="build"), "country_code = 'BX' and region ilike '%build%'", "P10: country and region of the row's own address.")
_search("search_seen_between", AdvancedQuery(seen_after="2023-03-01", seen_before="2023-06-30"), "first_seen >= timestamp '2023-03-01' and first_seen <= timestamp '2023-06-30'", "P9: time criteria.")
_search("table_filter_current", TableFilters(is_current=False, card_type="credit"), "not is_current and card_type = 'credit'", "P6: rows not current.")
_search("table_filter_length", TableFilters(prefix_length=8, funding_type="debit"), "prefix_length = 8 and funding_type = 'debit'", "P6: rows of one length and funding.")
_search("table_filter_city", TableFilters(text="customer#00000000", is_current=True), "is_current and (starts_with(bin, 'customer#00000000') or institution ilike '%customer#00000000%' or city ilike '%customer#00000000%')", "P6: text that only cities hold.")
_search("table_filter_text", TableFilters(text="400010"), "starts_with(bin, '400010') or institution ilike '%400010%' or city ilike '%400010%'", "P6: text over prefix, institution and city.")


@query("bin_rows", oracle(f"with {_ROWS} select * exclude (id, span_low) from bin_rows"))
def bin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per prefix with everything a table shows."""
    return _rows(spark, sf_dir).select(
        "bin", "prefix_length", "network_code", "country_code", "country", "card_type", "funding_type", "is_prepaid", "is_commercial", "status", "first_seen", "institution", "relationship_type", "is_current", "region", "city"
    )


@query("bin_rows_page1", oracle(f"with {_ROWS} select bin, network_code, country, card_type from bin_rows order by country asc nulls first, bin, id limit 50"))
def bin_rows_page1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: the first page by country."""
    return search.page(_rows(spark, sf_dir), "country", page=1, size=50).select("bin", "network_code", "country", "card_type")


@query("bin_rows_page3_desc", oracle(f"with {_ROWS} select bin, institution from bin_rows order by institution desc nulls last, bin, id limit 20 offset 40"))
def bin_rows_page3_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: a later page, descending."""
    return search.page(_rows(spark, sf_dir), "institution", descending=True, page=3, size=20).select("bin", "institution")


@query("bin_labels", oracle(f"with {_ROWS} select bin, case card_type when 'credit' then 'Credit' when 'debit' then 'Debit' when 'prepaid' then 'Prepaid' when 'charge' then 'Charge' when 'deferred_debit' then 'Deferred Debit' end as card_label, coalesce(institution, 'Unknown') as issuer from bin_rows"))
def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display labels."""
    shown = _rows(spark, sf_dir)
    return shown.select("bin", search.label(F.col("card_type")).alias("card_label"), F.when(search.is_blank_label(F.col("institution")), "Unknown").otherwise(F.col("institution")).alias("issuer"))


def _names(mode: str, needle: str, condition: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        inst, links, bins = (frame(spark, sf_dir, n) for n in ("bx_institutions", "bx_links", "bx_bins"))
        aliases = inst.select(F.col("id").alias("institution_id"), F.concat(F.lit("alias "), F.substring("normalized_name", -5, 5)).alias("normalized_alias"))
        ids = search.matching_institutions(inst, aliases, needle, mode)
        return search.by_institutions(bins, links, ids).select("bin")

    build.__doc__ = f"P11, U1, J6, J13: prefixes of institutions by name, {mode}."
    query(
        f"search_name_{mode}",
        oracle(f"""with ids as (select id from bx_institutions where {condition.format(c="normalized_name")} {"or display_name ilike '%" + needle + "%'" if mode == "contains" else ""}
        union select id from bx_institutions where {condition.format(c="('alias ' || substr(normalized_name, -5, 5))")})
        select bin from bx_bins where id in (select bin_id from bx_links where institution_id in (select id from ids))"""),
    )(build)


_names("exact", "supplier 000000007", "{c} = 'supplier 000000007'")
_names("prefix", "supplier 00000000", "starts_with({c}, 'supplier 00000000')")
_names("contains", "0004", "contains({c}, '0004')")


@query(
    "search_institutions",
    oracle("""select display_name, case when normalized_name = 'supplier 000000001' then 0 when starts_with(normalized_name, 'supplier 000000001') then 3 when starts_with(normalized_name, 'supplier 0') then 4 when contains(normalized_name, 'supplier 000000001') then 5 else 6 end as rank
    from bx_institutions where contains(normalized_name, 'supplier 000000001') order by rank, display_name limit 25"""),
)
def search_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked institutions."""
    return search.search_institutions(frame(spark, sf_dir, "bx_institutions"), "supplier 000000001", "supplier 0").select("display_name", "rank")


@query("browse_institutions", oracle("select display_name from bx_institutions order by display_name limit 20 offset 5"))
def browse_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institutions by name, one page."""
    return frame(spark, sf_dir, "bx_institutions").orderBy("display_name", "id").offset(5).limit(20).select("display_name")


@query(
    "suggest_bins",
    oracle("""select 'bin' as kind, b.bin as value, b.bin || ' · ' || coalesce(i.display_name, 'Unknown issuer') as label
    from (select * from bx_bins where starts_with(bin, '40001') order by bin, id limit 8) b left join (select bin_id, min(institution_id) as inst_id from bx_links where is_primary group by bin_id) p on p.bin_id = b.id left join bx_institutions i on i.id = p.inst_id"""),
)
def suggest_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type-ahead."""
    return search.suggestions(frame(spark, sf_dir, "bx_bins"), frame(spark, sf_dir, "bx_links"), frame(spark, sf_dir, "bx_institutions"), "4000-1")


@query(
    "palette",
    oracle("""select kind, value, label, rank from (
      select 'bin' as kind, bin as value, bin as label, 0 as rank from (select distinct bin from bx_bins where starts_with(bin, '40000'))
      union all select 'institution', uid, display_name, 1 from bx_institutions where contains(normalized_name, '00000001')) order by rank, kind, value limit 12"""),
)
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranked list from several sources."""
    bins = frame(spark, sf_dir, "bx_bins").where(F.col("bin").startswith("40000")).select(F.lit("bin").alias("kind"), F.col("bin").alias("value"), F.col("bin").alias("label"), F.lit(0).alias("rank"))
    inst = frame(spark, sf_dir, "bx_institutions").where(F.col("normalized_name").contains("00000001"))
    return search.merge_palette([bins, inst.select(F.lit("institution").alias("kind"), F.col("uid").alias("value"), F.col("display_name").alias("label"), F.lit(1).alias("rank"))], 12)


@query(
    "filter_values",
    oracle(f"""with {_ROWS} select distinct field, value from (
      select 'network_code' as field, network_code as value from bin_rows union all select 'country_code', country_code from bin_rows union all select 'card_type', card_type from bin_rows union all select 'status', status from bin_rows union all select 'region', region from bin_rows) where value is not null"""),
)
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: what each filter can offer."""
    return search.filter_values(_rows(spark, sf_dir), ["network_code", "country_code", "card_type", "status", "region"])


@query(
    "scope_filter",
    oracle("""select bin from bx_bins where card_type = 'credit' and country_id in (select id from bx_countries where iso2 = 'DX')
      and id in (select bin_id from bx_links where institution_id in (select institution_id from bx_addresses where region ilike '%furniture%'))
      and id in (select bin_id from bx_links where institution_id in (select id from bx_institutions where contains(normalized_name, '000') or display_name ilike '%000%'))"""),
)
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixes that a filtered report counts."""
    wanted = AdvancedQuery(card_type="credit", country_code="dx", region="furniture", institution="000")
    return search.scope(*(frame(spark, sf_dir, "bx_bins"), wanted), *(frame(spark, sf_dir, n) for n in ("bx_networks", "bx_countries", "bx_links", "bx_institutions", "bx_addresses"))).select("bin")


@query("portfolio_scope", oracle("select bin from bx_bins where id in (select bin_id from bx_links where institution_id in (1, 2, 3) and is_current)"))
def portfolio_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes that any of a few institutions holds now."""
    links = frame(spark, sf_dir, "bx_links").where(F.col("is_current") & F.col("institution_id").isin(1, 2, 3)).select(F.col("bin_id").alias("id"))
    return frame(spark, sf_dir, "bx_bins").join(links, "id", "left_semi").select("bin")


@query("bin_exists", oracle("select query_id, exists (select 1 from bx_bins b where b.bin = q.q) as known from bx_queries q"))
def bin_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: which queries are prefixes of their own."""
    known = frame(spark, sf_dir, "bx_bins").select(F.col("bin").alias("q"), F.lit(True).alias("known")).distinct()
    return frame(spark, sf_dir, "bx_queries").join(known, "q", "left").select("query_id", F.coalesce("known", F.lit(False)).alias("known"))
