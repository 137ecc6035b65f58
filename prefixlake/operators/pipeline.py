"""Ingest as set operations: facts, merge folds, enrichment, staging, learning, resolution and dedupe."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from prefixlake.functions import cards, digits, names
from prefixlake.functions.text import squash
from prefixlake.operators.lookup import is_issuing

CONFLICT_FIELDS = ("network", "country", "card_type", "funding_type", "status")
WEAK_BLOCK = 60


def fact_dedup(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each fact, at the position of the first (I1, W4): one grouped pass."""
    rest = [c for c in rows.columns if c not in key]
    kept = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("copies"))
    return kept.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest if c not in order], *[F.col(f"_first.{c}").alias(c) for c in order], "copies")


def keep_first(rows: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """The row of least ``order`` of each key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def claims(rows: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(key, source, field, value): the distinct claims of five or so fields, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(key, source, pairs.alias("p")).where("p.value is not null and p.value <> ''").select(key, source, "p.field", "p.value").distinct()


def merge_fields(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Ordered field-wise merge per key (I4): values, record confidence and the disagreements met.

    ``rows`` carry the fields, ``confidence`` and ``current`` (whether the row's claim is in the
    present). Blanks are filled; a disagreement is recorded, and the newcomer wins if its claim is
    current and better evidenced, or as good while no current issuer is known yet. Rows of a key
    stream through one task in order, and the task holds only the merged record and its distinct
    disagreements, however many rows a key has.
    """
    kind = rows.schema[key].dataType
    sorted_rows = rows.select(key, *order, *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)], F.col("confidence").cast("double").alias("_confidence"), F.col("current").alias("_current"))
    sorted_rows = sorted_rows.repartition(key).sortWithinPartitions(key, *order, *[f"_f{i}" for i in range(len(fields))], "_confidence", "_current")
    sorted_rows = sorted_rows.select(key, *[f"_f{i}" for i in range(len(fields))], "_confidence", "_current")
    schema = StructType([StructField(key, kind), *[StructField(f, StringType()) for f in fields], StructField("confidence", DoubleType())])
    met = StructType([StructField(n, StringType()) for n in ("field", "value_a", "value_b")])
    schema = schema.add("conflicts", ArrayType(met))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[list] = []
        record: list | None = None  # key, values, confidence, issued, conflicts
        wanted = to_arrow_schema(schema)

        def flush() -> pa.RecordBatch:
            found = [{wanted.names[0]: r[0], **dict(zip(fields, r[1], strict=True)), "confidence": r[2], "conflicts": [{"field": f, "value_a": a, "value_b": b} for f, a, b in r[4]]} for r in ready]
            ready.clear()
            return pa.RecordBatch.from_pylist(found, schema=wanted)

        for batch in batches:
            for k, *values, confidence, current in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if record is None or k != record[0]:
                    if record is not None:
                        ready.append(record)
                    record = [k, [None] * len(fields), confidence, False, {}]
                level = record[2] if record[2] is not None else confidence
                for i, new in enumerate(values):
                    old = record[1][i]
                    if new is None or new in ("", "unknown"):
                        continue
                    if old is None or old in ("", "unknown"):
                        record[1][i] = new
                    elif old != new:
                        record[4][fields[i], old, new] = True
                        # Fields merge one after the other, as each win raises the record's confidence.
                        if current and confidence is not None and level is not None and (confidence > level or (confidence == level and not record[3])):
                            record[1][i], level = new, confidence
                record[2], record[3] = level, record[3] or bool(current)
            if len(ready) >= 4096:
                yield flush()
        if record is not None:
            ready.append(record)
        yield flush()

    return sorted_rows.mapInArrow(fold, schema)


def enrich(bins: DataFrame, links: DataFrame, institutions: DataFrame, addresses: DataFrame, countries: DataFrame, networks: DataFrame | None = None, ranges: tuple[tuple[str, str, str], ...] = digits.SCHEME_RANGES, rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Four fills in order, blanks only (I10, J15): returns (bins, events).

    Institution country from its first address; prefix country from its current issuer (the least
    institution id where several); network from the digits where one scheme of ``ranges`` publishes
    them (with ``rest``, the last scheme has all other digits); currency from the country.
    """
    first = addresses.where("country_id is not null").groupBy("institution_id").agg(F.min_by("country_id", "id").alias("_address"))
    inst = institutions.join(first, institutions["id"] == first["institution_id"], "left").select(F.col("id").alias("institution_id"), F.coalesce("country_id", "_address").alias("_country"))
    own = links.where(F.col("is_current") & is_issuing(F.col("relationship_type"))).join(inst.where("_country is not null"), "institution_id")
    own = own.groupBy("bin_id").agg(F.min_by("_country", "institution_id").alias("_issuer_country"))
    out = bins.join(own, bins["id"] == own["bin_id"], "left").drop("bin_id")
    out = out.withColumn("_had", F.col("country_id")).withColumn("country_id", F.coalesce("country_id", "_issuer_country"))
    out = out.withColumn("scheme", F.when(F.col("network_id").isNull(), digits.scheme_of(F.col("bin"), ranges, rest)))
    land = countries.select(F.col("id").alias("country_id"), F.col("currency_code").alias("currency"))
    out = out.join(land, "country_id", "left")
    events = F.filter(
        F.array(
            F.when(F.col("_had").isNull() & F.col("country_id").isNotNull(), F.struct(F.lit("country_id").alias("field"), F.col("country_id").cast("string").alias("value"), F.lit("bin:issuer-country").alias("rule"))),
            F.when(F.col("scheme").isNotNull(), F.struct(F.lit("network").alias("field"), F.col("scheme").alias("value"), digits.scheme_rule(F.col("bin"), ranges, rest).alias("rule"))),
            F.when(F.col("currency").isNotNull(), F.struct(F.lit("currency_code").alias("field"), F.col("currency").alias("value"), F.lit("bin:country-currency").alias("rule"))),
        ),
        lambda e: e.isNotNull(),
    )
    return out.drop("_had", "_issuer_country"), out.select("bin", F.explode(events).alias("e")).select("bin", "e.*")


def stage(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Staged records with status and issue.

    ``raw`` (id, bin, bin_high, issuer, effective_from, effective_to, confidence); ``known``
    (normalized, institutions) counts the institutions of each normal form. Conflicts stay behind.
    """
    clean = digits.clean_digits(F.col("bin"))
    n = names.name_struct(F.col("issuer"))["normalized"]
    rows = raw.withColumn("prefix", clean).withColumn("normalized", n)
    issue = (
        F.when(~digits.is_prefix(F.col("prefix")) | F.col("prefix").isNull(), "prefix")
        .when(F.col("bin_high").isNotNull() & (digits.high(digits.clean_digits(F.col("bin_high"))) < digits.low(F.col("prefix"))), "range")
        .when(F.col("effective_to") < F.col("effective_from"), "dates")
        .when((F.col("confidence") <= 0) | (F.col("confidence") > 1), "confidence")
    )
    rows = rows.withColumn("issue", issue).join(known, "normalized", "left")
    return rows.withColumn("status", F.when(F.col("issue").isNotNull(), "rejected").when((F.col("normalized") != "") & (F.col("institutions") > 1), "conflicted").otherwise("resolved"))


def ledger(proposals: DataFrame, order: str) -> DataFrame:
    """The learning ledger after proposals in order (I15): equal to what is held or blank skipped, repeats dropped, earlier pending ones superseded."""
    value = F.trim("proposed_value")
    useful = proposals.withColumn("proposed_value", value).where((value != "") & ~F.coalesce(F.trim("current_value"), F.lit("")).eqNullSafe(value))
    key = ["subject_key", "field", "source_code"]
    once = keep_first(useful, [*key, "proposed_value"], order)
    later = Window.partitionBy(*key).orderBy(order)
    return once.withColumn("status", F.when(F.lead(order).over(later).isNotNull(), "superseded").otherwise("pending"))


def resolver_ladder(raw: DataFrame, institutions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw columns, match_type, institution_id, confidence) by exact normal form, then alias (M6).

    Every rung is one join on a grouped key, so a name with very many holders is counted, not fanned out.
    """
    n = names.name_struct(F.col("issuer"))
    keyed = raw.withColumn("_n", n["normalized"])
    exact = institutions.groupBy(F.col("normalized_name").alias("_n")).agg(F.count(F.lit(1)).alias("_c"), F.min("id").alias("_i"))
    other = aliases.groupBy(F.col("normalized_alias").alias("_n")).agg(F.countDistinct("institution_id").alias("_ac"), F.min("institution_id").alias("_ai"))
    out = keyed.join(exact, "_n", "left").join(other, "_n", "left")
    kind = F.when(F.col("_c") == 1, "canonical").when(F.col("_c") > 1, "conflict").when(F.col("_ac") == 1, "alias").when(F.col("_ac") > 1, "conflict").otherwise("unknown")
    score = F.when(kind == "canonical", 0.96).when(kind == "alias", 0.93).otherwise(0.0)
    return out.withColumn("match_type", kind).withColumn("institution_id", F.when(kind == "canonical", F.col("_i")).when(kind == "alias", F.col("_ai"))).withColumn("confidence", score).drop("_n", "_c", "_i", "_ac", "_ai")


def name_pairs(institutions: DataFrame, links: DataFrame, weak_block: int | None = WEAK_BLOCK) -> DataFrame:
    """Scored pairs of institutions that share a block key.

    Keys are the core name, its first word, and acronyms of three letters and more. A weak key that
    more than ``weak_block`` institutions share no longer discriminates and is not compared, as its
    definition says; None compares them at any size. Core keys always are, at any size: as whether two names merge depends on their
    countries and shared prefixes, every holder is compared with the least one of the name, of the name
    in its country, of the name without country and of the name on each of its prefixes, which connects
    whatever any pair of holders would connect. The sequence ratio runs once per distinct pair of core names.
    """
    n = names.name_struct(F.col("display_name"))
    own = institutions.select("id", "display_name", "country_id", n.alias("n"))
    keys = F.array(F.concat(F.lit("core:"), F.col("n.core")), F.concat(F.lit("lead:"), F.split("n.core", " ")[0]), F.when(F.length("n.acronym") >= 3, F.concat(F.lit("acronym:"), F.col("n.acronym"))))
    blocks = own.select("id", F.explode(F.filter(F.array_distinct(keys), lambda k: k.isNotNull())).alias("k"))
    sizes = blocks.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    core = blocks.where("k like 'core:%'").join(own.select("id", "country_id"), "id")
    nowhere = core.where("country_id is null").groupBy("k").agg(F.min("id").alias("least"))
    placed = core.groupBy("k", "country_id").agg(F.min("id").alias("least"))
    on_bins = core.join(links.select(F.col("institution_id").alias("id"), "bin_id").distinct(), "id")
    on_bins = on_bins.join(on_bins.groupBy("k", "bin_id").agg(F.min("id").alias("least")), ["k", "bin_id"])
    reach = [core.join(sizes.select("k", "least"), "k"), core.join(nowhere, "k"), core.join(placed, ["k", "country_id"]), on_bins]
    strong = reduce(DataFrame.union, [x.select("least", "id") for x in reach]).where("id <> least").select(F.least("id", "least").alias("a"), F.greatest("id", "least").alias("b"))
    weak = blocks.join(sizes.where((F.lit(True) if weak_block is None else F.col("n") <= weak_block) & (F.col("n") > 1) & ~F.col("k").like("core:%")).select("k"), "k", "left_semi")
    weak = weak.select("k", F.col("id").alias("a")).join(weak.select("k", F.col("id").alias("b")), "k").where("a < b").select("a", "b")
    pairs = strong.union(weak).distinct()
    left, right = own.select(*[F.col(c).alias(f"{c}_a") for c in own.columns]), own.select(*[F.col(c).alias(f"{c}_b") for c in own.columns])
    both = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))
    ratios = both.select(F.col("n_a.core").alias("ca"), F.col("n_b.core").alias("cb")).distinct().withColumn("ratio", names.sequence_ratio("ca", "cb"))
    both = both.join(ratios, (F.col("n_a.core") == F.col("ca")) & (F.col("n_b.core") == F.col("cb")))
    held = links.select("bin_id", "institution_id").distinct()
    common = pairs.join(held.withColumnRenamed("institution_id", "a"), "a").join(held.withColumnRenamed("institution_id", "b"), ["b", "bin_id"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    both = both.join(common, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    no = F.lit(False)
    same, other = F.coalesce(F.col("country_id_a") == F.col("country_id_b"), no), F.coalesce(F.col("country_id_a") != F.col("country_id_b"), no)
    m = names.match(names.similarity(F.col("n_a"), F.col("n_b"), F.col("ratio")), same, other, no, F.col("shared"), no, no, no)
    return both.select("a", "b", "display_name_a", "display_name_b", "shared", m.alias("m")).select("a", "b", "display_name_a", "display_name_b", "shared", "m.*")


def fuzzy_names(institutions: DataFrame, term: str, least: float = 0.82) -> DataFrame:
    """(id, display_name, score) of institutions near a typed name (M1, M2): blocked on its first four letters."""
    words = squash_text(term)
    lead = (words.split() or [""])[0][:4]
    n = names.name_struct(F.col("display_name"))
    near = institutions.where(F.col("normalized_name").startswith(lead) | F.col("normalized_name").contains(f" {lead}")).select("id", "display_name", n.alias("n"))
    score = F.greatest(names.sequence_ratio(F.lit(words), F.col("n.core")), names.sequence_ratio(F.lit(words), F.col("n.normalized")))
    return near.withColumn("score", score).where(F.col("score") >= least).select("id", "display_name", "score")


def squash_text(value: str) -> str:
    """The comparison form of one typed value, for parameters."""
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", re.sub(r"\s*&\s*", " and ", plain)).split()).lower()


def rewire(links: DataFrame, survivors: DataFrame) -> DataFrame:
    """Links moved to surviving institutions, clashes dropped (I13). ``survivors`` (old, kept)."""
    moved = links.join(survivors, links["institution_id"] == survivors["old"], "left").withColumn("institution_id", F.coalesce("kept", "institution_id")).drop("old", "kept")
    return keep_first(moved.withColumn("_o", F.xxhash64(*moved.columns)), ["bin_id", "institution_id", "relationship_type"], "_o").drop("_o")


def brand_rows(raw: DataFrame) -> DataFrame:
    """Free-text rows with network, card type, funding type and indicators."""
    kind = cards.card_type(F.col("type"))
    return raw.withColumns({"network": cards.network(F.col("brand")), "card_type": kind, "funding_type": cards.funding_type(F.col("type"), kind), "key": squash(F.col("issuer"))})


def gap_proposals(bins: DataFrame, links: DataFrame, institutions: DataFrame) -> DataFrame:
    """(bin, field, proposed_value): countries that any linked institution offers to prefixes without one."""
    inst = institutions.where("country_id is not null").select(F.col("id").alias("institution_id"), F.col("country_id").alias("_c"))
    gaps = bins.where("country_id is null").select("id", "bin").join(links.select(F.col("bin_id").alias("id"), "institution_id"), "id").join(inst, "institution_id")
    best = gaps.groupBy("bin").agg(F.min_by("_c", "institution_id").alias("_c"))
    return best.select("bin", F.lit("country_id").alias("field"), F.col("_c").cast("string").alias("proposed_value"))


def identities(raw: DataFrame, order: list[str]) -> DataFrame:
    """(key columns, survivor): which institution each raw (name, country) is, decided for all rows at once (M7).

    ``raw`` has issuer, iso2 and the order columns. A key is the normal form with its country; a key
    without country belongs to the only country-bearing key of that name, if there is exactly one.
    The survivor is the first row's ordinal of the key, so reruns and row order don't matter.
    """
    keyed = raw.where("issuer is not null").select("issuer", F.coalesce("iso2", F.lit("")).alias("iso2"), *order).withColumn("name", names.name_struct(F.col("issuer"))["normalized"]).where("name <> ''")
    keys = keyed.groupBy("name", "iso2").agg(F.min(F.struct(*order)).alias("first"), F.min_by("issuer", F.struct(*order)).alias("display_name"), F.count(F.lit(1)).alias("rows"))
    homes = keys.where("iso2 <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("iso2").alias("_home"))
    placed = keys.join(homes, "name", "left").withColumn("home", F.when((F.col("iso2") == "") & (F.col("_n") == 1), F.col("_home")).otherwise(F.col("iso2")))
    return placed.groupBy("name", "home").agg(F.min("first").alias("first"), F.min_by("display_name", "first").alias("display_name"), F.sum("rows").alias("rows"), F.sort_array(F.collect_set("iso2")).alias("countries"))


def fuller_names(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, display_name, abbreviation): the fullest spelling met of each institution, the first one kept as alias.

    Only spellings with the core of the first one compete; more words win, earlier rows among equals.
    """
    n = names.name_struct(F.col("display_name"))
    first = rows.withColumn("core", n["core"]).groupBy(key).agg(F.min_by("core", F.struct(*order)).alias("_core"), F.min_by("display_name", F.struct(*order)).alias("_first"))
    both = rows.withColumn("core", n["core"]).join(first, key).where(F.col("core") == F.col("_core"))
    words = -F.size(F.split("display_name", " "))
    best = both.groupBy(key).agg(F.min_by("display_name", F.struct(words, *order)).alias("display_name"), F.first("_first").alias("_first"))
    return best.select(key, "display_name", F.when(F.col("_first") != F.col("display_name"), F.col("_first")).alias("abbreviation"))


def survivors(pairs: DataFrame) -> DataFrame:
    """(old, kept): institutions that merge away, and the least id of what they merge with (M8).

    ``pairs`` is :func:`name_pairs`. Merging is transitive over pairs that may merge, which makes the
    outcome independent of the order in which pairs are met.
    """
    from prefixlake.operators.components import connected_components

    found = connected_components(pairs.where("can_merge").select("a", "b"))
    return found.where("id <> component").select(F.col("id").alias("old"), F.col("component").alias("kept"))


def conflict_proposals(conflicts: DataFrame) -> DataFrame:
    """(subject_key, field, proposed_value): the losing side of open conflicts as proposals (I16)."""
    return conflicts.where("status = 'open'").select(F.col("entity_key").alias("subject_key"), "field", F.col("value_b").alias("proposed_value")).distinct()


def decide(ledger_rows: DataFrame, decisions: DataFrame, fields: tuple[str, ...] = ("country_id", "network_id", "currency_code", "website", "phone")) -> DataFrame:
    """The ledger after decisions (id, approved), and automatic ones.

    Only pending facts can be decided and only whitelisted fields approved. A pending fact fills a
    blank by itself if its source is licensed and switched on (``auto``).
    """
    joined = ledger_rows.join(decisions.select("id", "approved"), "id", "left")
    allowed = F.col("field").isin(*fields)
    auto = F.coalesce("auto", F.lit(False)) & (F.coalesce("current_value", F.lit("")) == "") if "auto" in ledger_rows.columns else F.lit(False)
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("approved") & allowed, "approved").when(~F.col("approved"), "rejected").when(auto & allowed, "approved").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("approved")
