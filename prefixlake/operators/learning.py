"""Approved facts written into tables, with what each replaced beside it.

All facts of a field are one grouping: a subject becomes one row of its winning values, so a subject with
very many facts combines map-side, and the table is joined once. Nothing is lost when something can't be
written: a fact whose field may not be written, whose subject is gone or whose value means nothing stays
approved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions import cards
from prefixlake.session import checkpointed

# The fields that a learned fact may write.
BIN_FIELDS = ("brand", "card_level", "card_type", "funding_type", "currency_code", "network", "country")
INSTITUTION_FIELDS = ("website", "legal_name", "short_name", "swift_bic", "country")


@dataclass(frozen=True)
class Target:
    """A table that facts may change: its key, and where each writeable field goes.

    ``columns`` names the column of a field that is not its own. ``meanings`` (field, name, value) says
    what a proposed name stands for, case-blind, for the fields in ``named``; ``tidy`` normalises others.
    """

    key: str
    fields: tuple[str, ...]
    columns: dict[str, str] = field(default_factory=dict)
    named: tuple[str, ...] = ()
    tidy: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def column(self, name: str) -> str:
        return self.columns.get(name, name)


BINS = Target("bin", BIN_FIELDS, {"network": "network_id", "country": "country_id"}, ("network", "country"), {"currency_code": cards.currency, "card_level": cards.card_level})
INSTITUTIONS = Target("uid", INSTITUTION_FIELDS, {"country": "country_id"}, ("country",))


def apply_approved(table: DataFrame, facts: DataFrame, meanings: DataFrame, target: Target = BINS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, facts, provenance) after every approved fact was written.

    ``facts`` has id (unique), subject_key, field, current_value, proposed_value, source_code, confidence
    and status; of several for one field the greatest id wins, yet all that could be written count as
    ``applied`` and leave a provenance row. Fields that ``table`` lacks can't be written.
    """
    fields = [f for f in target.fields if target.column(f) in table.columns]
    approved = facts.where((F.col("status") == "approved") & F.col("field").isin(*fields))
    known = meanings.select(F.col("field").alias("_f"), F.lower(F.trim("name")).alias("_n"), F.col("value").cast("string").alias("_v")).groupBy("_f", "_n").agg(F.min("_v").alias("_v"))
    said = approved.join(known, (F.col("field") == F.col("_f")) & (F.lower(F.trim("proposed_value")) == F.col("_n")), "left")
    plain = F.coalesce(F.col("proposed_value"), F.lit(""))
    for name, tidy in target.tidy.items():
        plain = F.when(F.col("field") == name, tidy(F.col("proposed_value"))).otherwise(plain)
    value = F.when(F.col("field").isin(*target.named), F.col("_v")).otherwise(plain)
    said = said.withColumn("_value", value).where("_value is not null")
    held = table.select(F.col(target.key).alias("_key"), F.create_map(*[x for f in fields for x in (F.lit(f), F.col(target.column(f)).cast("string"))]).alias("_held")).where("_key is not null").dropDuplicates(["_key"])
    done = said.join(held, F.col("subject_key") == F.col("_key")).withColumn("replaced_value", F.try_element_at("_held", F.col("field")))
    done = checkpointed(done.select(*facts.columns, "_value", "replaced_value"))

    won = done.groupBy("subject_key").agg(*[F.max_by("_value", F.when(F.col("field") == f, F.col("id"))).alias(f"_new_{f}") for f in fields])
    both = table.join(won, F.col(target.key) == F.col("subject_key"), "left")
    kinds = dict(table.dtypes)
    back = {target.column(f): f for f in fields}
    changed = both.select(*[F.coalesce(F.col(f"_new_{back[c]}").cast(kinds[c]), F.col(c)).alias(c) if c in back else F.col(c) for c in table.columns])

    applied = done.select(F.col("id").alias("_id"))
    ledger = facts.join(applied, F.col("id") == F.col("_id"), "left").withColumn("status", F.when(F.col("_id").isNotNull(), "applied").otherwise(F.col("status"))).drop("_id")
    last = done.groupBy(F.col("subject_key").alias("_s"), F.col("field").alias("_f")).agg(F.max("id").alias("_last"))
    provenance = done.join(last, (F.col("subject_key") == F.col("_s")) & (F.col("field") == F.col("_f"))).select(
        F.col("id").alias("fact_id"),
        F.col("subject_key").alias("entity_key"),
        "field",
        F.col("current_value").alias("raw_value"),
        F.col("proposed_value").alias("normalized_value"),
        F.concat(F.lit("learned:"), F.col("source_code")).alias("rule"),
        "confidence",
        "replaced_value",
        F.col("_value").alias("written_value"),
        (F.col("id") == F.col("_last")).alias("in_force"),
    )
    return changed, ledger, provenance


def undo(table: DataFrame, facts: DataFrame, provenance: DataFrame, target: Target = BINS) -> tuple[DataFrame, DataFrame]:
    """(table, facts) with the facts of one application taken back.

    A field gets what it held before, unless something else was written since; its facts are approved
    again. ``provenance`` is that of :func:`apply_approved`, whole or the rows of some facts in force.
    """
    fields = [f for f in target.fields if target.column(f) in table.columns]
    gone = provenance.where("in_force")
    pair = F.struct(F.col("written_value").alias("was"), F.col("replaced_value").alias("before"))
    back = gone.groupBy("entity_key").agg(*[F.max(F.when(F.col("field") == f, pair)).alias(f"_old_{f}") for f in fields])
    both = table.join(back, F.col(target.key) == F.col("entity_key"), "left")
    kinds, names = dict(table.dtypes), {target.column(f): f for f in fields}
    restored = [
        F.when(F.col(f"_old_{names[c]}").isNotNull() & F.col(c).cast("string").eqNullSafe(F.col(f"_old_{names[c]}.was")), F.col(f"_old_{names[c]}.before").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
        for c in table.columns
    ]
    taken = provenance.select(F.col("fact_id").alias("_id")).distinct()
    ledger = facts.join(taken, F.col("id") == F.col("_id"), "left").withColumn("status", F.when(F.col("_id").isNotNull() & (F.col("status") == "applied"), "approved").otherwise(F.col("status"))).drop("_id")
    return both.select(*restored), ledger
