"""The issuer-prefix domain as views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from prefixlake.session import on_workers

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "bx_countries": """
        select n_nationkey as id, substr('ABCDEFGHIJKLMNOPQRSTUVWXY', n_nationkey + 1, 1) || 'X' as iso2, n_name as name, r_name as region,
               case when n_nationkey % 4 = 0 then null else substr('ABCDEFGHIJKLMNOPQRSTUVWXY', n_nationkey + 1, 1) || 'UR' end as currency_code
        from {nation} join {region} on n_regionkey = r_regionkey""",
    "bx_networks": """
        select distinct cast(substr(p_brand, 7) as int) as id, lower(replace(p_brand, '#', '_')) as code, p_brand as display_name from {part}""",
    "bx_institutions": """
        select s_suppkey as id, 'inst_' || substr(sha1(s_name), 1, 24) as uid, s_name as display_name, lower(replace(s_name, '#', ' ')) as normalized_name,
               s_nationkey as country_id, case when s_suppkey % 4 = 1 then s_suppkey - 1 end as parent_id
        from {supplier}""",
    "bx_bins": """
        select id, bin, length(bin) as prefix_length, case when length(bin) >= 8 then 'extended' else 'root' end as prefix_type,
               cast(rpad(substr(bin, 1, 8), 8, '0') as int) as span_low, cast(rpad(substr(bin, 1, 8), 8, '9') as int) as span_high,
               network_id, card_type, funding_type, is_prepaid, is_commercial, country_id, status, first_seen
        from (select p_partkey as id,
                case when p_partkey % 5 = 0 then cast(400000 + p_partkey - 1 as string) || lpad(cast(p_partkey % 100 as string), 2, '0')
                     else cast(400000 + p_partkey as string) end as bin,
                case when p_partkey % 13 = 0 then null else cast(substr(p_brand, 7) as int) end as network_id,
                case cast(p_partkey % 6 as int) when 0 then 'credit' when 1 then 'debit' when 2 then 'prepaid' when 3 then 'charge' when 4 then 'deferred_debit' else 'unknown' end as card_type,
                case p_size % 4 when 0 then 'credit' when 1 then 'debit' when 2 then 'prepaid' else 'unknown' end as funding_type,
                case when p_size % 5 = 0 then null else p_size % 2 = 0 end as is_prepaid,
                case when p_size % 7 = 0 then null else p_size % 3 = 0 end as is_commercial,
                case when p_partkey % 11 = 0 then null else cast(p_partkey % 25 as int) end as country_id,
                case when p_size % 10 = 0 then 'retired' when p_size % 10 = 1 then 'inactive' else 'active' end as status,
                cast('2023-' || lpad(cast(p_partkey % 12 + 1 as string), 2, '0') || '-15 00:00:00' as timestamp) as first_seen
              from {part}) t""",
    "bx_links": """
        select l_partkey as bin_id, l_suppkey as institution_id,
               case max(l_returnflag) when 'R' then 'former_issuer' when 'N' then 'issuer' else 'program_issuer' end as relationship_type,
               max(l_returnflag) <> 'R' as is_current, l_suppkey % 3 <> 0 as is_primary,
               min(l_shipdate) as effective_from, case when max(l_returnflag) = 'R' then max(l_shipdate) end as effective_to,
               cast(50 + (l_partkey + l_suppkey) % 50 as int) as confidence_pct
        from {lineitem} group by l_partkey, l_suppkey""",
    "bx_ranges": """
        select id, low_int as range_low_int, low_int + width - 1 as range_high_int, width - 1 as span, range_type, institution_id, is_current, effective_from, effective_to, confidence_pct
        from (select o_orderkey as id, cast((400000 + o_custkey) * 100 + (o_orderkey % 5) * 10 as int) as low_int,
                case substr(o_orderpriority, 1, 1) when '1' then 10 when '2' then 10 when '3' then 100 else 1000 end as width,
                case when substr(o_orderpriority, 1, 1) <= '2' then 'account_range' else 'issuer_range' end as range_type,
                case when o_orderkey % 7 = 0 then (o_custkey + 1) % 10 else o_custkey % 10 end as institution_id,
                o_orderkey % 4 <> 1 as is_current, case when o_orderkey % 3 <> 0 then o_orderdate end as effective_from, case when o_orderkey % 4 = 1 then o_orderdate end as effective_to,
                cast(case when o_orderkey % 5 <> 0 then 40 + o_orderkey % 60 end as int) as confidence_pct
              from {orders}) t""",
    "bx_queries": """
        select o_orderkey as query_id, case when o_orderkey % 3 = 0 then cast(400000 + o_custkey as string)
               else cast(400000 + o_custkey as string) || lpad(cast(o_orderkey % 100 as string), 2, '0') end as q
        from {orders}""",
    "bx_addresses": """
        select c_custkey as id, c_custkey % 12 as institution_id, c_mktsegment as region, c_name as city, c_nationkey as country_id, c_custkey % 3 = 0 as is_primary from {customer}""",
    "bx_edges": """
        select a.s_suppkey as institution_id, b.s_suppkey as related_institution_id,
               case cast(a.s_suppkey % 3 as int) when 0 then 'subsidiary' when 1 then 'predecessor' else 'processor_for' end as relationship_type
        from {supplier} a join {supplier} b on b.s_suppkey = a.s_suppkey + 3""",
    "bx_claims": """
        select event_id as id, user_id as bin_id, event_type as field, cast(cast(floor(value) as int) as string) as value, ts as observed_at from {events}""",
    "bx_staging": """
        select d.doc_id as id, d.source as batch_id, case when l.doc_id is null then 'received' when l.toxic = 1 then 'rejected' when l.quality = 1 then 'promoted' else 'conflicted' end as status
        from {documents} d left join {labels} l on l.doc_id = d.doc_id""",
}


#: Rows of line items that one task groups, at most about so many.
EACH = 1 << 20


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key``: few go to as many tasks as Spark finds good, many to so many that a task's share stays small."""
    parts = -(-rows.count() // EACH)
    if parts <= rows.sparkSession.sparkContext.defaultParallelism:
        return rows.repartition(key)
    return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view or a driver table as a DataFrame."""
    on_workers(spark)
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    tables = {t: frame(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    if name == "bx_links":
        # Dealt by prefix alone: links are grouped by prefix and institution first and mostly by prefix next.
        tables["lineitem"] = _dealt(tables["lineitem"].select("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"), "l_partkey")
    return spark.sql(text, **tables)


def oracle(text: str) -> str:
    """``text`` for DuckDB: the domain views that it names come first, as common table expressions."""
    needed = [v for v in VIEWS if re.search(rf"\b{v}\b", text)]
    ctes = [f"{v} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in needed]
    if not ctes:
        return text
    body = text.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(ctes)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"
