"""Institutions: the resolver with all its rungs, merges with what hangs on them, and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions import names
from prefixlake.operators.lookup import BASE_SCORE, is_issuing
from prefixlake.operators.numbering import numbered
from prefixlake.session import checkpointed

# The least score of a candidate, and how many candidates a name can have before it is too generic.
CANDIDATE, CANDIDATES = 0.55, 200
DETAILS = {"legal_name": "string", "country_id": "int", "website": "string", "swift_bic": "string", "postal_code": "string", "shared_bins": "int"}
SCALARS = ("legal_name", "website", "swift_bic", "country_id")


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def resolve_names(raw: DataFrame, institutions: DataFrame, aliases: DataFrame, most: int | None = CANDIDATES) -> DataFrame:
    """``raw`` with match_type, institution_id, confidence and the best candidate_id (M6).

    ``raw`` has issuer and any of ``DETAILS``; ``institutions`` id, display_name, normalized_name and any
    of normalized_legal_name, short_name and ``DETAILS``; ``aliases`` institution_id, normalized_alias.
    A country confines the first three rungs to its institutions. Legal name, then normal form (two
    holders are a conflict), then alias, then scored candidates: one that merges is strong, two are a
    conflict, none leaves a possibility. Each distinct question is answered once, and the exact rungs
    are one equi-join with the least and the greatest holder of a name, so no holder list is built.
    """
    asked = ["issuer", *DETAILS]
    keyed = _with(raw, DETAILS).withColumn("_ask", F.to_json(F.struct(*asked)))
    once = keyed.groupBy("_ask").agg(*[F.first(c).alias(c) for c in asked])
    once = once.withColumn("_n", names.name_struct(F.col("issuer"))).withColumn("_scope", F.coalesce(F.col("country_id").cast("string"), F.lit("")))
    once = checkpointed(once)  # three branches go on from the distinct questions
    legal = names.name_struct(F.col("legal_name"))["normalized"]
    wanted = once.where("_n.display <> ''").select("_ask", "_scope", F.posexplode(F.array(legal, F.col("_n.normalized"), F.col("_n.normalized"))).alias("_rung", "_key")).where("_key <> ''")
    known = _with(institutions, {"normalized_legal_name": "string", "short_name": "string", **DETAILS})
    land = F.col("country_id").cast("string").alias("_land")
    own = known.select("id", land, F.posexplode(F.array("normalized_legal_name", "normalized_name")).alias("_rung", "_key"))
    other = aliases.select(F.col("institution_id").alias("id"), F.col("normalized_alias").alias("_key")).join(known.select("id", land), "id")
    every = own.unionByName(other.withColumn("_rung", F.lit(2))).where("_key <> ''")
    every = every.select("id", "_rung", "_key", F.explode(F.array_compact(F.array(F.lit(""), F.col("_land")))).alias("_scope"))
    held = every.groupBy("_rung", "_key", "_scope").agg(F.min("id").alias("_least"), F.max("id").alias("_most"))
    single = F.when(F.col("_least") == F.col("_most"), F.col("_least"))
    met = wanted.join(held, ["_rung", "_key", "_scope"]).groupBy("_ask")
    met = met.agg(*[F.max(F.when(F.col("_rung") == i, single)).alias(n) for i, n in enumerate(("_exact", "_canonical", "_alias"))], F.max((F.col("_rung") == 1) & single.isNull()).alias("_twins"))
    once = once.join(met, "_ask", "left")
    kind = F.when(F.col("_n.display") == "", "unknown").when(F.col("_exact").isNotNull(), "exact").when(F.col("_canonical").isNotNull(), "canonical").when(F.col("_twins"), "conflict").when(F.col("_alias").isNotNull(), "alias")
    once = checkpointed(once.withColumn("_kind", F.when(F.col("_n").isNull() | F.col("issuer").isNull(), "unknown").otherwise(kind)))
    scored = candidates(once.where("_kind is null"), known, most)
    best = scored.groupBy("_ask").agg(F.max_by(F.struct("id", "score", "can_merge"), F.struct("score", -F.col("id"))).alias("_b"), F.count_if("can_merge").alias("_strong"))
    done = once.join(best, "_ask", "left")
    kind = F.coalesce("_kind", F.when(F.col("_b").isNull(), "unknown").when(F.col("_strong") > 1, "conflict").when(F.col("_b.can_merge"), "strong").otherwise("possible"))
    done = done.select("_ask", kind.alias("match_type"), "_exact", "_canonical", "_alias", "_b")
    m = F.col("match_type")
    done = done.select(
        "_ask",
        m,
        F.when(m == "exact", F.col("_exact")).when(m == "canonical", F.col("_canonical")).when(m == "alias", F.col("_alias")).when(m == "strong", F.col("_b.id")).alias("institution_id"),
        F.when(m == "exact", 0.99).when(m == "canonical", 0.96).when(m == "alias", 0.93).when(m.isin("strong", "possible"), F.round("_b.score", 4)).otherwise(0.0).alias("confidence"),
        F.col("_b.id").alias("candidate_id"),
    )
    return keyed.join(done, "_ask").select(*raw.columns, "match_type", "institution_id", "confidence", "candidate_id")


def candidates(once: DataFrame, known: DataFrame, most: int | None = CANDIDATES) -> DataFrame:
    """(_ask, id, score, can_merge): scored institutions that share a block with a question (M6's last rung).

    A question meets names equal to its normal form, core, first word or acronym, and names with its
    first four characters. As the definition has it, no question has more than ``most`` candidates; here
    they are the first by id, so a block too is cut to its first ``most`` before the join (None: all).
    """

    def first(df: DataFrame, key: str) -> DataFrame:
        if most is None:
            return df
        return df.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where(F.col("_at") <= most).drop("_at")

    def block(kind: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(f"{kind}:"), c))

    def lead(c: Column) -> Column:
        return F.when(F.length(c) >= 4, block("lead", F.substring(c, 1, 4)))

    n = F.col("_n")
    keys = [block("is", n["normalized"]), block("is", n["core"]), F.when(F.length(n["acronym"]) >= 3, block("is", n["acronym"])), block("is", F.split(n["normalized"], " ")[0]), lead(n["normalized"])]
    asks = once.select("_ask", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("_key"))
    stored = [block("is", F.col("normalized_name")), block("is", F.col("short_name")), lead(F.col("normalized_name"))]
    blocks = first(known.select("id", F.explode(F.array_distinct(F.array_compact(F.array(*stored)))).alias("_key")), "_key")
    pairs = first(asks.join(blocks, "_key").select("_ask", "id").distinct(), "_ask")
    detail = ["country_id", "website", "swift_bic", "postal_code"]
    left = once.select("_ask", F.col("_n").alias("_na"), F.col("shared_bins"), *[F.col(c).alias(f"_{c}") for c in detail])
    right = known.select("id", names.name_struct(F.col("display_name")).alias("_nb"), *detail)
    both = pairs.join(left, "_ask").join(right, "id")
    ratios = both.select(F.col("_na.core").alias("_ca"), F.col("_nb.core").alias("_cb")).distinct().withColumn("_ratio", names.sequence_ratio("_ca", "_cb"))
    both = both.join(ratios, (F.col("_na.core") == F.col("_ca")) & (F.col("_nb.core") == F.col("_cb")))

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    def said(c: str) -> Column:
        return ~_blank(F.col(c)) & ~_blank(F.col(f"_{c}"))

    swift = yes(said("swift_bic") & (F.upper(F.substring("swift_bic", 1, 6)) == F.upper(F.substring("_swift_bic", 1, 6))))
    host = yes(said("website") & (names.host(F.col("website")) == names.host(F.col("_website"))))
    place = yes(said("postal_code") & (F.col("postal_code") == F.col("_postal_code")))
    m = names.match(
        names.similarity(F.col("_na"), F.col("_nb"), F.col("_ratio")),
        yes(F.col("country_id") == F.col("_country_id")),
        yes(F.col("country_id") != F.col("_country_id")),
        swift,
        F.coalesce("shared_bins", F.lit(0)),
        host,
        F.lit(False),
        place,
    )
    return both.select("_ask", "id", m.alias("_m")).select("_ask", "id", "_m.score", "_m.can_merge").where(F.col("score") >= CANDIDATE)


def merge_institutions(institutions: DataFrame, survivors: DataFrame, links: DataFrame, aliases: DataFrame, addresses: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """Everything of merged institutions moved to the ones that stay.

    ``survivors`` (old, kept). Returns institutions, links, aliases, addresses and conflicts. Blanks of a
    survivor are filled by the first merged one that has a value, other values become conflicts (id,
    field, value_a, value_b); merged names stay as aliases. Of clashing rows the survivor's own stays,
    then those of the least merged id (``order`` breaks ties among links); addresses that move are not primary.
    Children follow; an institution whose parent merges into it has no parent any more.
    """
    moves = survivors.select(F.col("old").alias("_old"), F.col("kept").alias("_kept"))

    def moved(df: DataFrame, key: str = "institution_id") -> DataFrame:
        """``df`` with the new owner, and ``_from``: null where the row was the survivor's own."""
        out = df.join(moves, df[key] == moves["_old"], "left")
        return out.withColumn("_from", F.col("_old")).withColumn(key, F.coalesce("_kept", key)).drop("_old", "_kept")

    def kept_first(df: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in (*key, "_from", "_rank")]
        place = F.struct(F.coalesce("_from", F.lit(-1)), *ties)
        best = df.groupBy(*key).agg(F.min_by(F.struct(*rest, "_from"), place).alias("_r"))
        return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest], F.col("_r._from").alias("_from"))

    fields = [c for c in SCALARS if c in institutions.columns]
    gone = institutions.join(moves, institutions["id"] == moves["_old"]).drop("_old")
    stay = institutions.join(moves.select(F.col("_old").alias("id")), "id", "left_anti")
    fill = gone.groupBy(F.col("_kept").alias("id")).agg(*[F.min_by(c, F.when(~_blank(F.col(c)), F.col("id"))).alias(f"_{c}") for c in fields])
    filled = stay.join(fill, "id", "left")
    filled = filled.withColumns({c: F.when(_blank(F.col(c)), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in fields}).drop(*[f"_{c}" for c in fields])
    said = gone.select(F.col("_kept").alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value_b")) for c in fields])).alias("_v")).select("id", "_v.*").where(~_blank(F.col("value_b")))
    now = filled.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value_a")) for c in fields])).alias("_v")).select("id", "_v.*")
    conflicts = said.join(now, ["id", "field"]).where("value_a <> value_b").select("id", "field", "value_a", "value_b").distinct()
    parents = moved(filled, "parent_id").drop("_from") if "parent_id" in filled.columns else filled
    if "parent_id" in filled.columns:
        parents = parents.withColumn("parent_id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id")))

    held = aliases.select("institution_id", "alias", "normalized_alias", "alias_type", "confidence")
    own = moved(held).withColumn("_rank", F.lit(1))
    added = gone.select(F.col("_kept").alias("institution_id"), F.col("display_name").alias("alias"), names.name_struct(F.col("display_name"))["normalized"].alias("normalized_alias"), F.lit("variant").alias("alias_type"), F.lit(0.9).alias("confidence"), F.col("id").alias("_from"), F.lit(0).alias("_rank"))
    spellings = kept_first(own.unionByName(added.where("normalized_alias <> ''")), ["institution_id", "normalized_alias"], ["_rank", "alias"])
    places = kept_first(moved(addresses), ["institution_id", "fingerprint"], ["id"])
    return {
        "institutions": parents.select(*institutions.columns),
        "links": kept_first(moved(links), ["bin_id", "institution_id", "relationship_type"], order).select(*links.columns),
        "aliases": spellings.select(*held.columns),
        "addresses": places.withColumn("is_primary", F.col("is_primary") & F.col("_from").isNull()).select(*addresses.columns),
        "conflicts": conflicts,
    }


def upsert(state: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``state`` and the rows whose key it lacks, the first of each key by ``order``."""
    rest = [c for c in state.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return state.unionByName(first.join(state.select(*key), key, "left_anti").select(*state.columns))


def scored_links(links: DataFrame, length: Column) -> DataFrame:
    """Links with ``confidence_score`` and ``confidence_level`` as evidence has them (I5, K8); ``length`` is the prefix's."""
    base = F.when(length >= 8, BASE_SCORE["exact_assigned_bin"]).otherwise(BASE_SCORE["exact_6_digit"])
    score = base - F.when(is_issuing(F.col("relationship_type")), 0.0).otherwise(0.12) - F.when(F.col("is_current"), 0.0).otherwise(0.10)
    stored = F.greatest(F.lit(0.05), F.col("confidence"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.least(score, stored)))
    level = F.when(score >= 0.95, "verified").when(score >= 0.82, "high").when(score >= 0.60, "medium").otherwise("low")
    return links.withColumn("confidence_score", score).withColumn("confidence_level", level)


def upsert_addresses(state: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Addresses after new ones (I8): one per institution and fingerprint; the first is primary where none is.

    ``state`` has institution_id, fingerprint and is_primary; ``rows`` the same without is_primary, and ``order``.
    """
    key = ["institution_id", "fingerprint"]
    rest = [c for c in state.columns if c not in (*key, "is_primary")]
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_o"), F.min_by(F.struct(*rest, F.lit(0).alias("_x")), F.struct(*order)).alias("_r"))
    new = first.join(state.select(*key), key, "left_anti")
    lead = new.groupBy("institution_id").agg(F.min("_o").alias("_first"))
    had = state.where("is_primary").select("institution_id").distinct().withColumn("_had", F.lit(True))
    new = new.join(lead, "institution_id").join(had, "institution_id", "left")
    primary = (F.col("_o") == F.col("_first")) & F.col("_had").isNull()
    return state.unionByName(new.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest], primary.alias("is_primary")).select(*state.columns))


def upsert_dimension(held: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``held`` (id, key columns) with a new row for every value it lacks, ids after the greatest.

    Ids follow the values' order.
    """
    top = held.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = values.select(key).where(~_blank(F.col(key))).distinct().join(held.select(key), key, "left_anti")
    new = numbered(new, [F.col(key)], "_n").join(F.broadcast(top))  # one row
    return held.unionByName(new.select((F.col("_top") + F.col("_n")).cast(held.schema["id"].dataType).alias("id"), key), allowMissingColumns=True)
