"""Change detection between two releases, driven by a watch list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The watched fields of a prefix and of an institution, and the event of each.
BIN_FIELDS = {
    "institution": "institution_changed",
    "network": "network_changed",
    "card_type": "card_type_changed",
    "funding_type": "funding_type_changed",
    "country": "country_changed",
    "status": "status_changed",
    "city": "location_changed",
    "region": "location_changed",
    "postal_code": "location_changed",
}
INSTITUTION_FIELDS = {
    "display_name": "institution_changed",
    "legal_name": "institution_changed",
    "country": "country_changed",
    "website": "institution_changed",
    "status": "status_changed",
    "city": "location_changed",
    "region": "location_changed",
    "bin_count": "institution_changed",
}
LABELS = {"institution": "issuer", "card_type": "card type", "funding_type": "funding type", "postal_code": "postal code", "display_name": "name", "legal_name": "legal name", "bin_count": "associated BIN count", "region": "state or province"}


def latest(claims: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by a grouped maximum rather than a sort."""
    rest = [c for c in claims.columns if c not in key]
    best = claims.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _shown(c: Column) -> Column:
    """A stored value as people read it."""
    return F.when((F.lower(c) == c) & (F.upper(c) != c), F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))).otherwise(c)


def compare(before: DataFrame, after: DataFrame, fields: dict[str, str], target: str = "bin", watch: DataFrame | None = None) -> DataFrame:
    """Events between two snapshots keyed by ``target``.

    One full outer join on the key, restricted to watched keys on both sides first; differing fields
    become rows. Both-empty is no change; a count field tells additions from removals. A watch list
    is matched whole, so every list that watches a target is told (the summary names only the key).
    """
    if watch is not None:
        keys = watch.select(target).distinct()
        before, after = before.join(keys, target, "left_semi"), after.join(keys, target, "left_semi")
    old = before.select(target, F.struct(*fields).alias("_old"))
    new = after.select(target, F.struct(*fields).alias("_new"))
    return events(old.join(new, target, "full_outer"), fields, target)


def events(both: DataFrame, fields: dict[str, str], target: str = "bin", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of rows that hold a target's state before and after (``_old``, ``_new``; null where it is absent), with the columns ``keep``."""
    subject = F.concat(F.lit("BIN "), F.col(target)) if target == "bin" else F.col(target)
    noun = "bin" if target == "bin" else "institution"

    def event(kind: Column, field: Column, a: Column, b: Column, summary: Column) -> Column:
        return F.struct(kind.alias("change_type"), field.alias("field"), a.cast("string").alias("previous_value"), b.cast("string").alias("current_value"), summary.alias("summary"))

    none = F.lit(None).cast("string")
    found = []
    for name, kind in fields.items():
        a, b = F.col(f"_old.{name}").cast("string"), F.col(f"_new.{name}").cast("string")
        blank_a, blank_b = F.coalesce(a, F.lit("")) == "", F.coalesce(b, F.lit("")) == ""
        label = F.lit(LABELS.get(name, name.replace("_", " ")))
        text = (
            F.when(blank_a, F.concat(subject, F.lit(": "), label, F.lit(" set to "), _shown(b), F.lit(".")))
            .when(blank_b, F.concat(subject, F.lit(": "), label, F.lit(" is no longer recorded (was "), _shown(a), F.lit(").")))
            .otherwise(F.concat(subject, F.lit(": "), label, F.lit(" changed from "), _shown(a), F.lit(" to "), _shown(b), F.lit(".")))
        )
        refined = F.when(b.try_cast("long") > a.try_cast("long"), "bin_added").otherwise("bin_removed") if name == "bin_count" else F.lit(kind)
        differs = F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~(blank_a & blank_b) & ~a.eqNullSafe(b)
        found.append(F.when(differs, event(refined, F.lit(name), a, b, text)))
    first = next(iter(fields))
    found.append(F.when(F.col("_new").isNull(), event(F.lit(f"{noun}_removed"), none, F.to_json(F.struct(F.col(f"_old.{first}").cast("string").alias("was"))), none, F.concat(subject, F.lit(" is no longer present in the database.")))))
    found.append(F.when(F.col("_old").isNull(), event(F.lit(f"{noun}_added"), none, none, F.coalesce(F.col(f"_new.{first}").cast("string"), F.lit("")), F.concat(subject, F.lit(" has been added to the database.")))))
    rows = both.select(target, *keep, F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e"))
    return rows.select(target, *keep, "e.*")


def alerts(events: DataFrame, watch: DataFrame, target: str = "bin") -> DataFrame:
    """One alert per list that watches the target (C4); saved searches are not targets."""
    items = watch.where(F.col("target_type") != "saved_search").select("watchlist", target).distinct()
    return events.join(items, target)
