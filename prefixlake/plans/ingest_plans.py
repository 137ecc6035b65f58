"""Resolution, merging, upserts, rebuild and workspace queries over varied names and owners, with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixlake.functions.display import version_key
from prefixlake.operators import analytics, institutions, pipeline, rebuild, workspace
from prefixlake.plans.domain import frame, oracle
from prefixlake.plans.registry import query
from prefixlake.session import shared_folder
from prefixlake.sources import readers
from prefixlake.sources.release import Releases

_ASKED = """
  i as (select id, normalized_name as n, 'legal holder ' || cast(id % 40 as varchar) as legal, id % 3 as c from bx_institutions),
  a as (select c_custkey as k, case when c_custkey % 5 < 3 then c_custkey % 5 end as c,
    case c_custkey % 4 when 0 then 'supplier ' || lpad(cast(c_custkey % 15 as varchar), 9, '0') when 1 then 'nobody at all' when 2 then 'alias ' || cast(c_custkey % 9 as varchar) else 'zzz ' || cast(c_custkey as varchar) end as n,
    case when c_custkey % 4 = 1 then 'legal holder ' || cast(c_custkey % 40 as varchar) end as legal from customer),
  l as (select k, count(*) as m, min(id) as id from a join i on i.legal = a.legal and (a.c is null or a.c = i.c) group by 1),
  s as (select k, count(*) as m, min(id) as id from a join i on i.n = a.n and (a.c is null or a.c = i.c) group by 1),
  x as (select k, count(*) as m, min(id) as id from a join i on 'alias ' || cast(i.id % 9 as varchar) = a.n and i.id < 15 and (a.c is null or a.c = i.c) group by 1)"""


@query(
    "institution_resolution",
    oracle(f"""with {_ASKED}
    select a.k as c_custkey, case when l.m = 1 then 'exact' when s.m = 1 then 'canonical' when s.m > 1 then 'conflict' when x.m = 1 then 'alias' else 'other' end as match_type,
           case when l.m = 1 then l.id when s.m = 1 then s.id when s.m > 1 then null when x.m = 1 then x.id end as institution_id
    from a left join l on l.k = a.k left join s on s.k = a.k left join x on x.k = a.k"""),
)
def institution_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rungs; what only the scored rung answers is shown as other, as SQL has no sequence ratio."""
    k = F.col("c_custkey")

    def text(head: str, c):  # noqa: ANN001, ANN202
        return F.concat(F.lit(head), c.cast("string"))

    issuer = F.when(k % 4 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 15).cast("string"), 9, "0"))).when(k % 4 == 1, "Nobody at All").when(k % 4 == 2, text("ALIAS  ", k % 9)).otherwise(text("Zzz ", k))
    raw = frame(spark, sf_dir, "customer").select("c_custkey", issuer.alias("issuer"), F.when(k % 4 == 1, text("Legal Holder ", k % 40)).alias("legal_name"), F.when(k % 5 < 3, (k % 5).cast("int")).alias("country_id"))
    known = frame(spark, sf_dir, "bx_institutions").select("id", "display_name", "normalized_name", text("legal holder ", F.col("id") % 40).alias("normalized_legal_name"), (F.col("id") % 3).cast("int").alias("country_id"))
    aliases = known.where("id < 15").select(F.col("id").alias("institution_id"), text("alias ", F.col("id") % 9).alias("normalized_alias"))
    done = institutions.resolve_names(raw, known, aliases)
    return done.select("c_custkey", F.when(F.col("match_type").isin("exact", "canonical", "conflict", "alias"), F.col("match_type")).otherwise("other").alias("match_type"), F.when(F.col("match_type") != "strong", F.col("institution_id")).alias("institution_id"))


@query(
    "resolution_scored",
    oracle("""select c_custkey, case i % 4 when 0 then 'strong' when 1 then 'possible' when 2 then 'unknown' else 'conflict' end as match_type, case when i % 4 = 0 then i end as institution_id,
    cast(case i % 4 when 0 then 10000 when 1 then 9700 else 0 end as bigint) as confidence_e4, case when i % 4 <> 2 then i end as candidate_id from (select c_custkey, c_custkey % 10 as i from customer) t"""),
)
def resolution_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M5: names alike but for their legal form: backed by a website, by a country alone, in another country, and two that are as good."""

    def named(i: Column, form: str) -> Column:
        return F.concat(F.reverse(F.lpad(i.cast("string"), 6, "0")), F.lit(f"q trust {form}"))

    i = F.col("c_custkey") % 10
    site = F.when(i % 4 != 1, F.concat(F.lit("http://H"), i.cast("string"), F.lit(".example/about")))
    raw = frame(spark, sf_dir, "customer").select("c_custkey", named(i, "ltd").alias("issuer"), F.when(i % 4 == 2, (i + 1) % 3).otherwise(i % 3).cast("int").alias("country_id"), F.when(i % 4 != 2, site).alias("website"))
    k = F.col("id")
    website = F.concat(F.lit("https://www.h"), k.cast("string"), F.lit(".example"))
    one = frame(spark, sf_dir, "bx_institutions").select("id", named(k, "plc").alias("display_name"), (k % 3).cast("int").alias("country_id"), website.alias("website"))
    twin = one.where("id % 4 = 3").select((k + 1_000_000).alias("id"), F.replace("display_name", F.lit("plc"), F.lit("inc")).alias("display_name"), "country_id", "website")
    known = one.unionByName(twin).withColumn("normalized_name", F.lower("display_name"))
    done = institutions.resolve_names(raw, known, known.select(k.alias("institution_id"), F.lit("nobody").alias("normalized_alias")).where("false"))
    return done.select("c_custkey", "match_type", "institution_id", F.round(F.col("confidence") * 10000).cast("bigint").alias("confidence_e4"), "candidate_id")


_MERGED = """
  s as (select id as old, id - id % 3 as kept from bx_institutions where id % 3 > 0 and id > 3),
  i as (select id, display_name, normalized_name, case when id % 4 = 0 then null else 'L' || cast(id % 7 as varchar) end as legal, country_id, parent_id from bx_institutions),
  g as (select s.kept as id, arg_min(legal, i.id) filter (legal is not null) as legal from i join s on s.old = i.id group by 1),
  m as (select i.id, coalesce(i.legal, g.legal) as legal_name, i.country_id, coalesce(p.kept, i.parent_id) as parent from i left join g on g.id = i.id left join s p on p.old = i.parent_id where i.id not in (select old from s))"""


def _merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    inst = frame(spark, sf_dir, "bx_institutions").withColumn("legal_name", F.when(F.col("id") % 4 > 0, F.concat(F.lit("L"), (F.col("id") % 7).cast("string"))))
    survivors = inst.where("id % 3 > 0 and id > 3").select(F.col("id").alias("old"), (F.col("id") - F.col("id") % 3).alias("kept"))
    fifth = (F.col("id") % 5).cast("string")
    aliases = inst.select(F.col("id").alias("institution_id"), F.concat(F.lit("A "), fifth).alias("alias"), F.concat(F.lit("a "), fifth).alias("normalized_alias"), F.lit("listed").alias("alias_type"), F.lit(0.5).alias("confidence"))
    addresses = frame(spark, sf_dir, "bx_addresses").select("id", "institution_id", F.col("region").alias("fingerprint"), "is_primary")
    return institutions.merge_institutions(inst, survivors, frame(spark, sf_dir, "bx_links"), aliases, addresses, ["confidence_pct", "effective_from"])


@query("merged_institutions", oracle(f"with {_MERGED} select id, legal_name, country_id, nullif(parent, id) as parent_id from m"))
def merged_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors with filled blanks and moved parents."""
    return _merged(spark, sf_dir)["institutions"].select("id", "legal_name", "country_id", "parent_id")


@query(
    "merge_conflicts",
    oracle(f"""with {_MERGED} select distinct s.kept as id, 'legal_name' as field, m.legal_name as value_a, i.legal as value_b from i join s on s.old = i.id join m on m.id = s.kept where i.legal <> m.legal_name
    union all select distinct s.kept, 'country_id', cast(m.country_id as varchar), cast(i.country_id as varchar) from i join s on s.old = i.id join m on m.id = s.kept where i.country_id <> m.country_id"""),
)
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merged institutions said differently."""
    return _merged(spark, sf_dir)["conflicts"]


@query(
    "merged_aliases",
    oracle(f"""with {_MERGED}, every as (select coalesce(s.kept, i.id) as institution_id, 'a ' || cast(i.id % 5 as varchar) as normalized_alias, 'listed' as alias_type, coalesce(s.old, -1) as f, 1 as r from i left join s on s.old = i.id
      union all select s.kept, i.normalized_name, 'variant', s.old, 0 from i join s on s.old = i.id)
    select institution_id, normalized_alias, arg_min(alias_type, (f, r)) as alias_type from every group by 1, 2"""),
)
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases moved, merged names kept as aliases."""
    return _merged(spark, sf_dir)["aliases"].select("institution_id", "normalized_alias", "alias_type")


@query(
    "merged_addresses",
    oracle(f"""with {_MERGED}, every as (select coalesce(s.kept, a.institution_id) as institution_id, a.region as fingerprint, a.id, a.is_primary and s.old is null as is_primary, coalesce(s.old, -1) as f from bx_addresses a left join s on s.old = a.institution_id)
    select institution_id, fingerprint, arg_min(id, (f, id)) as id, arg_min(is_primary, (f, id)) as is_primary from every group by 1, 2"""),
)
def merged_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses moved, none of them primary."""
    return _merged(spark, sf_dir)["addresses"].select("institution_id", "fingerprint", "id", "is_primary")


@query(
    "link_evidence",
    oracle("""with l as (select bin_id, institution_id, relationship_type, 0.97e0 - case when relationship_type in ('former_issuer') then 0.12e0 else 0 end - case when is_current then 0 else 0.10e0 end as s, confidence_pct / 100e0 as c from bx_links)
    select bin_id, institution_id, cast(round(least(s, c) * 10000) as int) as score from l"""),
)
def link_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with their evidence score."""
    lengths = frame(spark, sf_dir, "bx_bins").select(F.col("id").alias("bin_id"), "prefix_length")
    links = frame(spark, sf_dir, "bx_links").withColumn("confidence", F.col("confidence_pct") / 100.0).join(lengths, "bin_id", "left")
    done = institutions.scored_links(links, F.coalesce("prefix_length", F.lit(6)))
    return done.select("bin_id", "institution_id", F.round(F.col("confidence_score") * 10000).cast("int").alias("score"))


@query(
    "address_upsert",
    oracle("""with st as (select id, institution_id, region as fingerprint, is_primary from bx_addresses where id < 12), n as (select institution_id, region as fingerprint, min(id) as id from bx_addresses where id >= 12 group by 1, 2),
    k as (select n.* from n left join st on st.institution_id = n.institution_id and st.fingerprint = n.fingerprint where st.id is null), f as (select institution_id, min(id) as id from k group by 1)
    select * from st union all select k.id, k.institution_id, k.fingerprint, k.id = f.id and k.institution_id not in (select institution_id from st where is_primary) from k join f on f.institution_id = k.institution_id"""),
)
def address_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: new addresses, the first one primary where none is."""
    every = frame(spark, sf_dir, "bx_addresses").select("id", "institution_id", F.col("region").alias("fingerprint"), "is_primary")
    return institutions.upsert_addresses(every.where("id < 12"), every.where("id >= 12").drop("is_primary"), ["id"])


@query(
    "range_upsert",
    oracle("""with r as (select range_low_int, range_high_int, institution_id, min(id) filter (range_type = 'account_range') as held, min(id) filter (range_type <> 'account_range') as new from bx_ranges group by 1, 2, 3)
    select range_low_int, range_high_int, institution_id, coalesce(held, new) as id from r"""),
)
def range_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that are new to the ones held."""
    rows, key = frame(spark, sf_dir, "bx_ranges"), ["range_low_int", "range_high_int", "institution_id"]
    held = pipeline.keep_first(rows.where("range_type = 'account_range'").select(*key, "id"), key)
    return institutions.upsert(held, rows.where("range_type <> 'account_range'").select(*key, "id"), key, ["id"])


@query(
    "dimension_upsert",
    oracle("""with h as (select cast(id as int) as id, code from bx_networks where id < 30), n as (select distinct code from bx_networks where id >= 30)
    select id, code from h union all select cast((select coalesce(max(id), 0) from h) + row_number() over (order by code) as int), code from n"""),
)
def dimension_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks met in the feed that the dimension lacks."""
    rows = frame(spark, sf_dir, "bx_networks")
    return institutions.upsert_dimension(rows.where("id < 30").select("id", "code"), rows, "code")


@query("version_order", oracle("""with v as (select distinct cast(c_custkey % 12 as varchar) || '.' || cast(c_custkey % 7 as varchar) as version, c_custkey % 12 as a, c_custkey % 7 as b from customer) select version, row_number() over (order by a, b) as place from v"""))
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distinct versions in their own order, not the text's."""
    k = F.col("c_custkey")
    rows = frame(spark, sf_dir, "customer").select(F.concat_ws(".", (k % 12).cast("string"), (k % 7).cast("string")).alias("version")).distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(version_key(F.col("version"))))).withColumn("place", F.col("place").cast("long"))


@query(
    "reading_differences",
    oracle("""select id, 'status' as field, status as held, 'frozen' as reading from bx_bins where id % 4 = 1 union all select id, 'card_type', card_type, 'credit' from bx_bins where id % 3 = 0 and card_type <> 'credit'"""),
)
def reading_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where outside readings of single prefixes say something else."""
    bins = frame(spark, sf_dir, "bx_bins").select("id", "status", "card_type")
    outside = bins.select("id", F.when(F.col("id") % 4 == 1, "frozen").otherwise(F.upper(F.concat(F.lit(" "), "status"))).alias("status"), F.when(F.col("id") % 3 == 0, "credit").alias("card_type"))
    return readers.reading_differences(bins, outside, ["status", "card_type"], key="id")


@query("conflict_proposals", oracle("select distinct bin_id as subject_key, field, value as proposed_value from bx_claims where id % 2 = 0"))
def conflict_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: the losing sides of open conflicts as proposals."""
    rows = frame(spark, sf_dir, "bx_claims").select(F.col("bin_id").alias("entity_key"), "field", F.col("value").alias("value_b"), F.when(F.col("id") % 2 == 0, "open").otherwise("settled").alias("status"))
    return pipeline.conflict_proposals(rows)


@query(
    "favourites_toggle",
    oracle("""with s as (select distinct bin_id, value from bx_claims where id % 2 = 0), r as (select distinct bin_id, value from bx_claims where id % 2 = 1)
    (select * from s except select * from r) union all (select * from r except select * from s)"""),
)
def favourites_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.Q: favourites after toggling."""
    rows = frame(spark, sf_dir, "bx_claims").select("id", "bin_id", "value")
    return workspace.toggle(rows.where("id % 2 = 0").select("bin_id", "value").distinct(), rows.where("id % 2 = 1").select("bin_id", "value").distinct(), ["bin_id", "value"])


@query(
    "precomputed_statistics",
    oracle("""with e as (select 'all' as scope, * from bx_bins union all select 'country:' || cast(country_id as varchar), * from bx_bins where country_id is not null),
    g as (select scope, count(*) as bins, count(distinct network_id) as networks, count(*) filter (is_prepaid) as prepaid, count(*) filter (status = 'active') as active from e group by 1)
    select scope, 'bins' as key, bins as value from g union all select scope, 'networks', networks from g union all select scope, 'prepaid', prepaid from g union all select scope, 'active', active from g"""),
)
def precomputed_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures per scope, written once and read back."""
    path = f"{shared_folder(spark)}/statistics-{uuid.uuid4().hex}"
    analytics.statistics(frame(spark, sf_dir, "bx_bins")).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "rebuild_tables",
    oracle("""with r as (select c_custkey % 200 as b, c_custkey % 40 as i from customer where c_custkey % 11 > 0)
    select 'bins' as "table", count(distinct b) as rows from r union all select 'institutions', count(distinct i) from r union all select 'links', count(distinct (b, i)) from r union all select 'staging', count(*) from customer"""),
)
def rebuild_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild from raw records, published; the rows of its tables."""
    k = F.col("c_custkey")
    text = frame(spark, sf_dir, "customer").select(
        k.alias("line"),
        F.when(k % 11 == 0, "12").otherwise((400000 + k % 200).cast("string")).alias("bin"),
        F.concat(F.lit("Bank "), (k % 40).cast("string")).alias("issuer"),
        F.when(k % 40 % 2 == 0, "AX").otherwise("BX").alias("iso2"),
        F.lit("issuer").alias("relationship"),
        F.lit("2020-01-01").cast("timestamp").alias("effective_from"),
        F.lit(None).cast("timestamp").alias("effective_to"),
        (0.5 + (k % 5) / 10.0).alias("confidence"),
        F.when(k % 2 == 0, "visa").alias("network"),
        (k % 25).cast("string").alias("country_id"),
        F.when(k % 3 == 0, "credit").otherwise("debit").alias("card_type"),
        F.lit("unknown").alias("funding_type"),
        F.lit("active").alias("status"),
    )
    held = Releases(spark, f"{shared_folder(spark)}/rebuilt-{uuid.uuid4().hex}")
    manifest = rebuild.rebuild(held, "1", "2024-01-01", text, frame(spark, sf_dir, "bx_countries"))
    return manifest.where(F.col("table").isin("bins", "institutions", "links", "staging")).select("table", "rows")


@query("duplicate_queries", oracle("select q, count(*) as n from bx_queries group by q having count(*) > 1"))
def duplicate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once."""
    return analytics.duplicate_groups(frame(spark, sf_dir, "bx_queries"), "q")


@query(
    "saved_searches",
    oracle("""with s as (select 'Search ' || cast(bin_id as varchar) as name, max(id) as query, bin_id % 4 = 0 as pinned from bx_claims where id % 2 = 0 group by bin_id),
    n as (select 'search ' || cast(bin_id as varchar) as name, max(id) as query, true as pinned from bx_claims where id % 2 = 1 and bin_id % 3 = 0 group by bin_id)
    select * from s where lower(name) not in (select name from n) union all select * from n"""),
)
def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.Q: saved searches after others of the same names, whatever their case, were saved."""
    rows = frame(spark, sf_dir, "bx_claims")
    name = F.col("bin_id").cast("string")
    state = rows.where("id % 2 = 0").groupBy("bin_id").agg(F.max("id").alias("query")).select(F.concat(F.lit("Search "), name).alias("name"), "query", (F.col("bin_id") % 4 == 0).alias("pinned"))
    new = rows.where("id % 2 = 1 and bin_id % 3 = 0").groupBy("bin_id").agg(F.max("id").alias("query")).select(F.concat(F.lit("search "), name).alias("name"), "query", F.lit(True).alias("pinned"))
    return workspace.saved_searches(workspace.upsert(state, new, ["name"]))


@query("pruned_history", oracle("select id, bin_id, observed_at from bx_claims where observed_at >= timestamp '2024-01-10 00:00:00'"))
def pruned_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.Q: what is left when everything older than a day is let go."""
    return workspace.prune(frame(spark, sf_dir, "bx_claims").select("id", "bin_id", "observed_at"), "observed_at", "2024-01-10 00:00:00")
