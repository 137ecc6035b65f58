"""Counts, distributions, growth, portfolios, quality and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.operators.joins import expand_graph

TOP_N = 10
PORTFOLIO_EDGES = ("subsidiary", "predecessor", "brand_of")


def database_stats(bins: DataFrame, institutions: DataFrame, ranges: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row of totals (A2): each table is one counting pass, and the one-row results are put side by side."""
    out = bins.agg(F.count(F.lit(1)).alias("bins"), F.countDistinct("country_id").alias("countries"), F.countDistinct("network_id").alias("networks"))
    for name, df in (("institutions", institutions), ("ranges", ranges), ("addresses", addresses)):
        out = out.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return out


def distribution(bins: DataFrame, key: Column) -> DataFrame:
    """(key, value): counts without null and unknown."""
    return bins.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value")).where("key is not null and key not in ('', 'unknown')")


def with_share(dist: DataFrame, total: int | Column | None = None) -> DataFrame:
    """``dist`` with each value's share of the sum, in parts per million; 0 when there is nothing (A10)."""
    whole = F.sum("value").over(Window.partitionBy()) if total is None else F.lit(total)
    held = dist.withColumn("_t", whole)
    return held.withColumn("share_ppm", F.when(F.col("_t") > 0, F.expr("value * 1000000 div nullif(_t, 0)")).otherwise(F.lit(0).cast("long"))).drop("_t")


def top_with_other(dist: DataFrame, keep: int = TOP_N) -> DataFrame:
    """The largest ``keep`` slices, the rest folded into one ``__other__`` (A9). A distribution has one row per category, so ranking it in one partition is cheap."""
    ranked = dist.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("value"), "key")))
    folded = F.when(F.col("rn") <= keep, F.col("key")).otherwise("__other__")
    return ranked.groupBy(folded.alias("key")).agg(F.sum("value").alias("value")).where("value > 0")


def growth(bins: DataFrame, periods: int = 12) -> DataFrame:
    """(period, added, cumulative): the last months, running from the first of them."""
    months = bins.where("first_seen is not null").groupBy(F.date_format("first_seen", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("added"))
    last = months.orderBy(F.desc("period")).limit(periods)
    run = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumn("cumulative", F.sum("added").over(run))


def institution_stats(bins: DataFrame, links: DataFrame) -> DataFrame:
    """Per institution: distinct prefixes, credit, debit, prepaid, commercial, countries (A5, A6, J6) for all of them at once."""
    own = links.select("institution_id", "bin_id").distinct().join(bins, F.col("bin_id") == bins["id"])
    return own.groupBy("institution_id").agg(
        F.count(F.lit(1)).alias("bins"),
        F.count_if(F.col("card_type") == "credit").alias("credit"),
        F.count_if(F.col("card_type") == "debit").alias("debit"),
        F.count_if(F.col("is_prepaid")).alias("prepaid"),
        F.count_if(F.col("is_commercial")).alias("commercial"),
        F.countDistinct("country_id").alias("countries"),
    )


def top_institutions(links: DataFrame, institutions: DataFrame, keep: int = 12) -> DataFrame:
    """Institutions by number of links, of every kind."""
    counts = links.groupBy("institution_id").agg(F.count(F.lit(1)).alias("links"))
    named = counts.join(institutions.select(F.col("id").alias("institution_id"), "display_name"), "institution_id")
    return named.orderBy(F.desc("links"), "display_name").limit(keep)


def contributing(institutions: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): each root with what it owns, succeeds or brands, and children by parent, four levels deep."""
    steps = edges.where(F.col("relationship_type").isin(*PORTFOLIO_EDGES)).select(F.col("institution_id").alias("parent"), F.col("related_institution_id").alias("child"))
    steps = steps.union(institutions.where("parent_id is not null").select("parent_id", "id")).distinct()
    return expand_graph(roots, steps).select("root", "id")


def portfolio_bins(family: DataFrame, bins: DataFrame, links: DataFrame) -> DataFrame:
    """One row per (root, bin value): current if any link is.

    A link meets its prefix before the roots of its institution, so the rows that roots make of it move once.
    """
    roots = family.groupBy("id").agg(F.count(F.lit(1)).alias("_roots"))
    parts = _parts(links.groupBy("institution_id").agg(F.count(F.lit(1)).alias("_links")).join(roots, F.col("institution_id") == F.col("id")), F.col("_roots") * F.col("_links"))
    own = links.select("institution_id", "bin_id", "is_current").join(bins.select(F.col("id").alias("bin_id"), "bin", "prefix_length", "network_id", "country_id"), "bin_id").drop("bin_id")
    own = own.repartition(parts, "institution_id").join(family.repartition(parts, "id"), F.col("institution_id") == family["id"]).drop("institution_id", "id")
    own = own.repartition(parts, "root", "bin").groupBy("root", "bin")
    return own.agg(F.max("is_current").alias("is_current"), F.min("prefix_length").alias("prefix_length"), F.min("network_id").alias("network_id"), F.min("country_id").alias("country_id"))


def portfolio_counts(held: DataFrame) -> DataFrame:
    """Totals per root."""
    return held.groupBy("root").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_current")).alias("current"),
        F.count_if(~F.col("is_current")).alias("historical"),
        F.count_if(F.col("prefix_length") < 8).alias("roots"),
        F.count_if(F.col("prefix_length") >= 8).alias("extended"),
    )


HOLDERS = 256
#: Rows that one task groups in memory, at most about so many.
EACH = 1 << 20


def _parts(rows: DataFrame, weight: Column) -> int:
    """Tasks for the rows that ``rows`` become by their ``weight``, summed in one pass, so a task's share doesn't grow with them."""
    total = rows.agg(F.sum(weight).cast("long")).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // EACH))


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, null a value like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def contested_ranges(ranges: DataFrame, institutions: DataFrame) -> DataFrame:
    """Ranges that several institutions claim, with the claimants' names."""
    named = ranges.join(institutions.select(F.col("id").alias("institution_id"), "display_name"), "institution_id")
    found = named.groupBy("range_low_int", "range_high_int").agg(F.countDistinct("institution_id").alias("claimants"), F.array_join(F.array_sort(F.collect_set("display_name")), "|").alias("names"))
    return found.where("claimants > 1")


def quality_metrics(bins: DataFrame, links: DataFrame, ranges: DataFrame, institutions: DataFrame, open_conflicts: int | DataFrame = 0) -> DataFrame:
    """(key, numerator, denominator) of the twelve metrics (A17): one pass per table, then rows by ``stack``."""
    one = bins.agg(
        F.count(F.lit(1)).alias("bins"),
        F.count_if(F.col("prefix_length") >= 8).alias("extended"),
        F.count_if(F.col("prefix_length") == 6).alias("roots"),
        F.count("country_id").alias("countries"),
        F.count("network_id").alias("networks"),
    )
    link = links.groupBy("bin_id").agg(F.max("is_current").alias("c")).agg(F.count(F.lit(1)).alias("linked"), F.count_if("c").alias("current"))
    span = ranges.agg(F.count(F.lit(1)).alias("ranges"), F.count_if(F.col("range_type") == "account_range").alias("account"))
    inst = institutions.agg(F.count(F.lit(1)).alias("institutions"))
    dup = duplicate_groups(bins, "bin", "prefix_length").agg(F.count(F.lit(1)).alias("dup_bins"))
    dup_inst = duplicate_groups(institutions, "normalized_name", "country_id").agg(F.count(F.lit(1)).alias("dup_inst"))
    for part in (link, span, inst, dup, dup_inst):
        one = one.join(F.broadcast(part))  # one row each
    one = one.withColumn("open", F.lit(open_conflicts).cast("long"))
    return one.selectExpr(
        """stack(12, 'institution_resolution', current, bins, 'extended_coverage', extended, bins, 'root_coverage', roots, bins, 'country_coverage', countries, bins,
        'network_coverage', networks, bins, 'current_coverage', current, linked, 'range_coverage', account, ranges, 'duplicate_rate', dup_bins, bins,
        'duplicate_institution_rate', dup_inst, institutions, 'conflict_rate', open, bins, 'missing_institution_rate', greatest(0, bins - current), bins,
        'missing_country_rate', bins - countries, bins) as (key, numerator, denominator)"""
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose key is set and names no parent (J7); null keys are not orphans."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def ratio_score(count: Column, total: Column, tolerance: float) -> Column:
    """1 without faults, falling to 0 as their share of the total reaches the tolerance."""
    return F.when(count <= 0, 1.0).when(total <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - count / total / tolerance))


def shared_bins(links: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of institutions that hold the same prefixes.

    Prefixes with the same holders are counted as one set with a weight. A set's holders are paired in
    runs of ``HOLDERS``, each a row of its own dealt to any task, so a prefix that very many hold is many
    small tasks; the pairs are made and counted where they are made, and only sums are shuffled. There are
    as many tasks as the pairs, counted beforehand from the sizes of the sets, ask for.
    """
    sets = links.groupBy("bin_id").agg(F.array_sort(F.collect_set("institution_id")).alias("held")).where(F.size("held") > 1)
    parts = _parts(sets, F.size("held").cast("long") * (F.size("held") - 1) / 2)
    sets = sets.groupBy("held").agg(F.count(F.lit(1)).alias("n"))
    runs = sets.select("held", "n", F.explode(F.sequence(F.lit(1), F.size("held"), F.lit(HOLDERS))).alias("first"))
    runs = runs.withColumn("_task", F.pmod(F.xxhash64("held", "first"), F.lit(parts)).cast("int")).repartitionById(parts, "_task")
    ones = runs.select("_task", "held", "n", "first", F.posexplode(F.slice("held", F.col("first"), F.lit(HOLDERS))).alias("at", "a"))
    pairs = ones.select("_task", "n", "a", F.explode(F.slice("held", F.col("first") + F.col("at") + 1, F.size("held"))).alias("b"))
    # Rows of one ``_task`` are in one task, so this sums before anything moves.
    pairs = pairs.groupBy("_task", "a", "b").agg(F.sum("n").alias("n"))
    return pairs.repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("shared"))


def status_counts(staging: DataFrame) -> DataFrame:
    """Staged records by batch and status."""
    return staging.groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("records"))


def without_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose key is null or names a parent (I14): what stays when orphans are deleted."""
    known = child.join(parent.select(F.col(parent_key).alias(key)), key, "left_semi").select(*child.columns)
    return known.unionByName(child.where(F.col(key).isNull()))


def snapshot(bins: DataFrame, links: DataFrame, institutions: DataFrame, ranges: DataFrame) -> DataFrame:
    """(metric, value): the headline figures of a scope in one pass over its prefixes."""
    one = bins.agg(
        F.count(F.lit(1)).alias("bins"),
        F.countDistinct("country_id").alias("countries"),
        F.countDistinct("network_id").alias("networks"),
        F.count_if(F.col("card_type") == "credit").alias("credit"),
        F.count_if(F.col("card_type") == "debit").alias("debit"),
        F.count_if(F.col("card_type") == "charge").alias("charge"),
        F.count_if("is_prepaid").alias("prepaid"),
        F.count_if("is_commercial").alias("commercial"),
    )
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns])).alias("m")).select("m.*")
    scoped = links.join(bins.select(F.col("id").alias("bin_id")), "bin_id", "left_semi").agg(F.lit("institutions").alias("metric"), F.countDistinct("institution_id").alias("value"))
    every = institutions.agg(F.lit("all_institutions").alias("metric"), F.count(F.lit(1)).alias("value"))
    return rows.unionByName(scoped).unionByName(every).unionByName(ranges.agg(F.lit("ranges").alias("metric"), F.count(F.lit(1)).alias("value")))


def statistics(bins: DataFrame) -> DataFrame:
    """(scope, key, value): figures of all prefixes and of each country's (A13), in one grouping that combines map-side."""
    scopes = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("country:"), F.col("country_id").cast("string"))))
    one = bins.select(F.explode(scopes).alias("scope"), "network_id", "is_prepaid", "status").groupBy("scope")
    one = one.agg(F.count(F.lit(1)).alias("bins"), F.countDistinct("network_id").alias("networks"), F.count_if("is_prepaid").alias("prepaid"), F.count_if(F.col("status") == "active").alias("active"))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in one.columns[1:]]))
    return one.select("scope", rows.alias("r")).select("scope", "r.*")


def partials(bins: DataFrame) -> DataFrame:
    """(scope, measure, value, n): what :func:`statistics` is made of, in parts that add up.

    A distinct count is kept as the multiset it counts, so rows can leave it as well as come.
    """
    scopes = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("country:"), F.col("country_id").cast("string"))))
    none = F.lit(None).cast("string")

    def part(measure: str, counts: Column, value: Column = none) -> Column:
        return F.struct(F.lit(measure).alias("measure"), value.alias("value"), F.when(F.coalesce(counts, F.lit(False)), 1).otherwise(0).cast("long").alias("n"))

    each = F.array(
        part("bins", F.lit(True)), part("networks", F.col("network_id").isNotNull(), F.col("network_id").cast("string")), part("prepaid", F.col("is_prepaid")), part("active", F.col("status") == "active")
    )
    rows = bins.select(F.explode(scopes).alias("scope"), each.alias("each")).select("scope", F.explode("each").alias("p")).select("scope", "p.*")
    return rows.groupBy("scope", "measure", "value").agg(F.sum("n").alias("n"))


def delta(before: DataFrame, after: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(added, removed) rows between two releases; a changed row is both."""
    # The hash passes over nulls, so it is also told which columns are null: a value may move from one to another.
    gone = [F.xxhash64(*before.columns, *[F.col(c).isNull() for c in before.columns]).alias("_h"), F.col(key).alias("_k")]
    same = ["_k", "_h"]
    old, new = before.select("*", *gone), after.select(*before.columns).select("*", *gone)
    return new.join(old.select(*same), same, "left_anti").drop(*same), old.join(new.select(*same), same, "left_anti").drop(*same)


def maintained(state: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The parts after rows came and went: only the delta is aggregated, then added to ``state``."""
    change = partials(added).unionByName(partials(removed).withColumn("n", -F.col("n")))
    return state.unionByName(change).groupBy("scope", "measure", "value").agg(F.sum("n").alias("n")).where("n <> 0 or measure <> 'networks'")


def figures(state: DataFrame) -> DataFrame:
    """(scope, key, value) of maintained parts: what :func:`statistics` gives. A scope without prefixes is gone."""
    value = F.when(F.first("measure") == "networks", F.count_if((F.col("n") > 0) & F.col("value").isNotNull())).otherwise(F.sum("n"))
    rows = state.groupBy("scope", F.col("measure").alias("key")).agg(value.alias("value"))
    living = state.where("measure = 'bins' and n > 0").select("scope")
    keys = living.select("scope", F.explode(F.array(*[F.lit(k) for k in ("bins", "networks", "prepaid", "active")])).alias("key"))
    return keys.join(rows, ["scope", "key"], "left").select("scope", "key", F.coalesce("value", F.lit(0)).alias("value"))
