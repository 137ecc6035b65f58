"""The composed rebuild: stage, ingest, enrich, detect, learn, write, verify, publish (I11 promotion, I17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.operators import pipeline
from prefixlake.session import checkpointed
from prefixlake.sources.release import Releases

FIELDS = ["network", "country_id", "card_type", "funding_type", "status"]


def build(records: DataFrame, countries: DataFrame) -> dict[str, DataFrame]:
    """The tables of a release from raw ``records``.

    ``records`` has line (unique), bin, issuer, iso2, relationship, effective_from, effective_to,
    confidence and ``FIELDS``; ``countries`` id, iso2 and currency_code. Only resolved records are
    promoted; rejected and conflicted ones stay in ``staging`` with their issue. Alike institutions
    are listed in ``duplicates`` and not merged; what links could teach goes to ``proposals``.
    """
    known = pipeline.identities(records, ["line"]).groupBy(F.col("name").alias("normalized")).agg(F.count(F.lit(1)).alias("institutions"))
    staged = pipeline.stage(records.withColumn("bin_high", F.lit(None).cast("string")).withColumn("id", F.col("line")), known)
    staged = checkpointed(staged.withColumn("stage", F.when(F.col("issue").isNotNull(), "rejected").when((F.col("normalized") != "") & (F.col("institutions") > 1), "conflicted").otherwise("promoted")).drop("institutions"))
    good = staged.where("stage = 'promoted'")
    found = pipeline.identities(good, ["line"]).select(F.col("first.line").alias("id"), "display_name", F.col("name").alias("normalized_name"), "home", "countries")
    lands = countries.select(F.col("id").alias("country_id"), F.col("iso2").alias("home"))
    institutions = checkpointed(found.join(lands, "home", "left"))
    owner = institutions.select(F.col("id").alias("institution_id"), F.col("normalized_name").alias("normalized"), F.explode("countries").alias("_home"))
    current = F.col("effective_to").isNull()
    linked = good.withColumn("_home", F.coalesce("iso2", F.lit(""))).join(owner, ["normalized", "_home"])
    linked = linked.select(F.col("prefix").alias("bin_id"), "institution_id", F.col("relationship").alias("relationship_type"), current.alias("is_current"), "confidence", "line")
    links = checkpointed(pipeline.keep_first(linked, ["bin_id", "institution_id", "relationship_type"], "line"))
    merged = pipeline.merge_fields(good.withColumn("current", current), "prefix", ["line"], FIELDS)
    merged = checkpointed(merged.withColumn("country_id", F.col("country_id").cast("int")).withColumn("network_id", F.col("network")).withColumnRenamed("prefix", "bin").withColumn("id", F.col("bin")))
    no_addresses = institutions.select("id", F.col("id").alias("institution_id"), "country_id").where("false")
    bins, events = pipeline.enrich(merged.drop("conflicts"), links, institutions, no_addresses, countries)
    pairs = pipeline.name_pairs(institutions.select("id", "display_name", "country_id"), links)
    return {
        "bins": bins.drop("network_id"),
        "institutions": institutions.drop("countries"),
        "links": links,
        "conflicts": merged.select("bin", F.explode("conflicts").alias("c")).select("bin", "c.*"),
        "enrichment": events,
        "duplicates": pairs.where("can_merge or needs_review").select("a", "b", "score", "can_merge"),
        "proposals": pipeline.gap_proposals(bins, links, institutions),
        "staging": staged.select("line", "bin", "issuer", "stage", "issue"),
    }


def rebuild(held: Releases, version: str, at: str, records: DataFrame, countries: DataFrame, allow_shrink: bool = False) -> DataFrame:
    """Build, write, verify and publish a release; returns its manifest.

    A release that shrank to under half the live one, that doesn't verify, or that was overtaken by
    another publisher while it was built, raises and is not published: the live one stays as it was, and
    :meth:`Releases.rollback` undoes a published one.
    """
    seen = held.seen()
    held.write(version, build(records, countries), allow_shrink=allow_shrink)
    held.publish(version, at, seen)
    return held.manifest(version)
