"""Prefix lookup: which allocation answers a query, how well it is supported, and who disagrees.

Inputs are frames of one row per allocation: prefixes (id, bin, span_low, span_high) and ranges
(id, range_low_int, range_high_int, range_type, institution_id, is_current, effective_from, effective_to,
confidence_pct). A query meets its prefixes on equality, at most one a length, and its ranges through one
elementary interval, where the best range and what every institution claims there are known beforehand;
so a distinct query is a few rows, not one for every range that contains it. Relationships of a prefix
are an array of structs; ranking, disagreement, settlement and scoring are array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.functions import digits
from prefixlake.operators.intervals import cut, locate, starts
from prefixlake.operators.joins import children_join, prefix_join, range_join

# Precedence of match kinds, and the score each starts from.
SPECIFICITY = {"exact_8_digit": 6, "exact_assigned_bin": 6, "account_range": 5, "exact_6_digit": 4, "broader_range": 3, "root_prefix": 2, "none": 0}
BASE_SCORE = {"exact_8_digit": 0.97, "exact_assigned_bin": 0.97, "account_range": 0.93, "exact_6_digit": 0.97, "broader_range": 0.76, "root_prefix": 0.76}
CONFIDENCE_MARGIN = 0.15
#: Queries and allocations that one task of :func:`reached` lays out as blocks, at most about so many.
EACH = 1 << 18

RELATION = "struct<id:bigint,name:string,relationship:string,is_primary:boolean,is_current:boolean,confidence:double,effective_from:timestamp,effective_to:timestamp>"


def _pick(strategy: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(strategy == k, F.lit(v)).otherwise(out)
    return out


def relations(links: DataFrame, institutions: DataFrame) -> DataFrame:
    """(bin_id, relations): the links of each prefix as one array, ordered by institution."""
    named = links.join(institutions.select(F.col("id").alias("_i"), "display_name"), F.col("institution_id") == F.col("_i"))
    one = F.struct(
        F.col("institution_id").cast("bigint").alias("id"),
        F.col("display_name").alias("name"),
        F.col("relationship_type").alias("relationship"),
        "is_primary",
        "is_current",
        (F.col("confidence_pct") / 100.0).alias("confidence"),
        F.col("effective_from").cast("timestamp").alias("effective_from"),
        F.col("effective_to").cast("timestamp").alias("effective_to"),
    )
    return named.groupBy("bin_id").agg(F.sort_array(F.collect_list(one)).alias("relations"))


def _prefix_strategy(stored: Column, asked: Column) -> Column:
    return F.when(stored != asked, "root_prefix").when(stored >= 8, "exact_8_digit").when(stored == 6, "exact_6_digit").otherwise("exact_assigned_bin")


def prefix_candidates(queries: DataFrame, bins: DataFrame, *more: str) -> DataFrame:
    """(query_id, q, kind, id, bin, strategy, span, *more) of every prefix that contains a query (K1); ``more`` are columns of ``bins``."""
    found = prefix_join(queries, bins.select("id", "bin", "span_low", "span_high", *more))
    strategy = _prefix_strategy(F.length("bin"), F.length("q"))
    return found.select("query_id", "q", F.lit("prefix").alias("kind"), F.col("id").cast("bigint").alias("id"), "bin", strategy.alias("strategy"), (F.col("span_high") - F.col("span_low") + 1).cast("bigint").alias("span"), *more)


def range_candidates(queries: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same of every range that contains a query (K1, P4); ``bin`` is the query."""
    found = range_join(queries, ranges, digits.low(F.col("q")), "range_low_int", "range_high_int")
    strategy = F.when(F.col("range_type") == "account_range", "account_range").otherwise("broader_range")
    return found.select(
        "query_id", "q", F.lit("range").alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("q").alias("bin"), strategy.alias("strategy"), (F.col("range_high_int") - F.col("range_low_int") + 1).cast("bigint").alias("span")
    )


def range_cover(ranges: DataFrame, institutions: DataFrame, holders: bool = True, claims: bool = True) -> DataFrame:
    """(start, best, ranges, holders) of each elementary interval.

    ``best`` is the range that wins there, ``ranges`` how many hold. ``holders``, if asked for, lists the
    institutions that ranges name there, how many do, and the best current one of them as a claim. A
    range without a known owner has no relationships. Without ``claims``, only holders and their numbers
    are known. Names are grouping keys, so what is compared and moved is of fixed width.
    """
    strategy = F.when(F.col("range_type") == "account_range", "account_range").otherwise("broader_range")
    one = [
        (-_pick(strategy, SPECIFICITY)).alias("neg"),
        (F.col("range_high_int") - F.col("range_low_int") + 1).cast("bigint").alias("span"),
        (~F.coalesce("is_current", F.lit(True))).alias("past"),
        F.col("id").cast("bigint").alias("id"),
    ]
    more = [(F.col("confidence_pct") / 100.0).alias("confidence"), F.col("effective_from").cast("timestamp").alias("effective_from"), F.col("effective_to").cast("timestamp").alias("effective_to")]
    owner = institutions.select(F.col("id").cast("bigint").alias("institution"), F.col("display_name").alias("name"))
    own = ranges.withColumn("_i", F.col("institution_id").cast("bigint")).join(owner, F.col("_i") == F.col("institution"), "left")
    if not holders:
        own = own.select("range_low_int", "range_high_int", F.struct(*one, "institution", "name", *more).alias("best"))
        return cut(own, "range_low_int", "range_high_int", [], {"_best": F.min("best"), "_n": F.count(F.lit(1))}, {"best": F.min("_best"), "ranges": F.coalesce(F.sum("_n"), F.lit(0))}).drop("cell")
    if not claims:
        held = cut(own, "range_low_int", "range_high_int", ["institution"], {"_n": F.count(F.lit(1))}, {"n": F.sum("_n")})
        return held.groupBy("cell", "start").agg(F.collect_list(F.when(F.col("institution").isNotNull(), F.struct(F.col("institution").alias("id"), "n"))).alias("holders")).drop("cell")
    own = own.select("range_low_int", "range_high_int", "institution", "name", F.struct(*one, *more).alias("r"))
    held = cut(
        own,
        "range_low_int",
        "range_high_int",
        ["institution", "name"],
        {"_claim": F.min(F.when(~F.col("r.past"), F.col("r"))), "_gone": F.min(F.when(F.col("r.past"), F.col("r"))), "_n": F.count(F.lit(1))},
        {"claim": F.min("_claim"), "gone": F.min("_gone"), "n": F.sum("_n")},
    )
    best = F.least("claim", "gone")
    whole = F.when(best.isNotNull(), F.struct(*[best[n].alias(n) for n in ("neg", "span", "past", "id")], "institution", "name", *[best[n].alias(n) for n in ("confidence", "effective_from", "effective_to")]))
    claim = F.when(F.col("claim").isNotNull(), F.struct(*[F.col(f"claim.{n}").alias(n) for n in ("neg", "span", "past", "id", "confidence", "effective_from")]))
    holder = F.struct(F.col("institution").alias("id"), "n", claim.alias("claim"))
    held = held.groupBy("cell", "start").agg(F.min(whole).alias("best"), F.coalesce(F.sum("n"), F.lit(0)).alias("ranges"), F.collect_list(F.when(F.col("institution").isNotNull(), holder)).alias("holders"))
    return held.drop("cell")


def _intervals(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """(q, at): the start of the interval of each distinct query of ``asked`` (q); several may have one value."""
    valued = asked.select("q", digits.low(F.col("q")).cast("long").alias("value")).where("value is not null")
    found = locate(valued.select("value").distinct(), "value", starts(ranges, "range_low_int", "range_high_int").withColumn("at", F.col("start")))
    return valued.join(found, "value").select("q", "at")


def _range_struct(best: Column, relations_too: bool) -> Column:
    """The best range as a candidate of the same shape as a prefix; ``bin`` is the query."""
    fields = [best["neg"].alias("neg"), best["span"].alias("span"), best["past"].alias("past"), F.col("q").alias("bin"), F.lit("range").alias("kind"), best["id"].alias("id"), F.when(best["neg"] == -SPECIFICITY["account_range"], "account_range").otherwise("broader_range").alias("strategy")]
    if relations_too:
        fields.append(_range_relations(best).alias("relations"))
    return F.when(best.isNotNull(), F.struct(*fields))


def _range_relations(best: Column) -> Column:
    one = F.struct(
        best["institution"].alias("id"),
        best["name"].alias("name"),
        F.lit("issuer").alias("relationship"),
        F.lit(True).alias("is_primary"),
        (~best["past"]).alias("is_current"),
        best["confidence"].alias("confidence"),
        best["effective_from"].alias("effective_from"),
        best["effective_to"].alias("effective_to"),
    )
    return F.when(best["institution"].isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{RELATION}>"))


def _prefix_struct(*more: str) -> Column:
    """Most specific, narrowest, current, then by value and id: least first."""
    return F.struct((-_pick(F.col("strategy"), SPECIFICITY)).alias("neg"), "span", (~F.col("is_current")).alias("past"), "bin", "kind", "id", "strategy", *more)


def _current(bins: DataFrame, known: DataFrame) -> DataFrame:
    """``bins`` with ``is_current``: what ``known`` (bin_id, _any) says, true where nothing is known."""
    return bins.join(known, bins["id"] == known["bin_id"], "left").withColumn("is_current", F.coalesce("_any", F.lit(True))).drop("bin_id", "_any")


def winners(queries: DataFrame, bins: DataFrame, ranges: DataFrame, links: DataFrame, institutions: DataFrame) -> DataFrame:
    """One row per answered query: the winning allocation, its relationships, and the number of candidates.

    Relationships are met last, by the winner alone, and go nowhere from there; before, an allocation
    carries only what ranks it.
    """
    asked = queries.select("q").distinct()
    # The links are moved once for both: what ranks a prefix, and the relationships of those that win.
    held = relations(links, institutions).withColumn("_any", F.array_max(F.transform("relations", lambda r: r["is_current"])))
    current = _current(bins.select("id", "bin", "span_low", "span_high"), held.select("bin_id", "_any"))
    found = prefix_candidates(asked.withColumn("query_id", F.col("q")), current, "is_current")
    own = found.groupBy("q").agg(F.min(_prefix_struct()).alias("_prefix"), F.count(F.lit(1)).alias("_prefixes"))
    cover = range_cover(ranges, institutions, False)
    both = own.join(_intervals(asked, ranges), "q", "full").join(cover, F.col("at") == F.col("start"), "left")
    # ``least`` orders structs by their fields and passes over nulls.
    won = both.withColumn("w", F.least("_prefix", _range_struct(F.col("best"), False))).where("w is not null")
    won = won.select("q", "w.*", (F.coalesce("_prefixes", F.lit(0)) + F.coalesce("ranges", F.lit(0))).alias("candidates"), F.when(F.col("w.kind") == "range", F.col("best")).alias("best"))
    won = won.select("q", "kind", "id", "bin", "strategy", (-F.col("neg")).alias("specificity"), "span", (~F.col("past")).alias("is_current"), "candidates", "best")
    won = queries.select("query_id", "q").join(won, "q")
    # A range brings its relationship; a prefix meets its own where they are. Ranges are dealt to any task.
    keyed = won.withColumn("_key", F.when(F.col("best").isNull(), F.col("id")).otherwise(F.xxhash64("query_id")))
    done = keyed.join(held.withColumnRenamed("relations", "_held"), (F.col("_key") == F.col("bin_id")) & F.col("best").isNull(), "left")
    known = F.when(F.col("best").isNotNull(), _range_relations(F.col("best"))).otherwise(F.coalesce("_held", F.array().cast(f"array<{RELATION}>")))
    # What its relationships say of a prefix is what has ranked it.
    done = done.withColumn("is_current", F.when(F.col("best").isNull(), F.coalesce("_any", F.lit(True))).otherwise(F.col("is_current")))
    return done.withColumn("relations", known).drop("best", "_key", "bin_id", "_any", "_held")


def _ranked(bins: DataFrame, links: DataFrame) -> DataFrame:
    """``bins`` with ``is_current`` where it can decide between lengths, and true elsewhere.

    Of two prefixes that contain a query and are equally specific, the longer is the narrower; only those of eight
    digits and more are equally narrow. Links are met if any of these differ in length within their first eight digits.
    """
    size = F.length("bin")
    several = bins.where(size >= 8).groupBy(F.substring("bin", 1, 8).alias("_head")).agg(F.min(size).alias("_least"), F.max(size).alias("_most")).where("_least < _most")
    if several.isEmpty():
        return bins.withColumn("is_current", F.lit(True))
    unclear = bins.where(size >= 8).join(several, F.substring("bin", 1, 8) == F.col("_head"), "left_semi").select(F.col("id").alias("bin_id"))
    return _current(bins, links.join(unclear, "bin_id", "left_semi").groupBy("bin_id").agg(F.max("is_current").alias("_any")))


def _parts(*every: DataFrame) -> int | None:
    """Tasks for so many rows, so that a task's share does not grow with them; None, for Spark to choose, if they are few."""
    spark = every[0].sparkSession
    parts = -(-sum(rows.count() for rows in every) // EACH)
    return None if parts <= spark.sparkContext.defaultParallelism else max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))


def reached(queries: DataFrame, bins: DataFrame, ranges: DataFrame, links: DataFrame) -> DataFrame:
    """(strategy, length, n): how many queries are answered by each kind of allocation with digits of each length.

    A query is its first eight digits and its length, equal ones are counted first, and a prefix is a range with a
    length. Both meet in their cell (:func:`intervals.cut`), each moved there once, and stay there; of an allocation
    only what can decide the strategy and the length is known.
    """
    asked = queries.select(digits.low(F.col("q")).cast("long").alias("start"), F.length("q").alias("asked")).where("start is not null").groupBy("start", "asked").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("range_type") == "account_range", "account_range").otherwise("broader_range")
    by_range = ranges.select(F.col("range_low_int").cast("long").alias("low"), F.col("range_high_int").cast("long").alias("high"), kind.alias("range"))
    by_prefix = _ranked(bins.select("id", "bin", "span_low", "span_high"), links)
    by_prefix = by_prefix.select(F.col("span_low").cast("long").alias("low"), F.col("span_high").cast("long").alias("high"), F.length("bin").alias("size"), F.struct((~F.col("is_current")).alias("past"), "bin").alias("first"))
    every = by_range.unionByName(by_prefix, allowMissingColumns=True)
    met = cut(every, "low", "high", ["range", "size"], {"_first": F.min("first")}, {"first": F.min("_first")}, asked, _parts(queries, bins, ranges)).where("range is not null or size <= asked")
    strategy = F.coalesce("range", _prefix_strategy(F.col("size"), F.col("asked")))
    # Least first, as in ``_prefix_struct``; no range is as specific as a prefix.
    one = F.struct((-_pick(strategy, SPECIFICITY)).alias("neg"), (-F.least("size", F.lit(8))).alias("wide"), "first.past", "first.bin", strategy.alias("strategy"), F.coalesce("size", "asked").alias("length"))
    won = met.groupBy("cell", "start", "asked", "n").agg(F.min(one).alias("w"))
    return won.groupBy("w.strategy", "w.length").agg(F.sum("n").alias("n"))


def is_issuing(relationship: Column) -> Column:
    return relationship.isin("issuer", "program_issuer")


def current_issuers(rel: Column) -> Column:
    """Distinct current issuers of an allocation, primary first, then by name (K4, K5)."""
    own = F.filter(rel, lambda r: r["is_current"] & is_issuing(r["relationship"]))
    first = F.filter(own, lambda r, i: F.forall(F.slice(own, F.lit(1), i), lambda e: e["id"] != r["id"]))
    # Looking back from every one is quadratic; as a rule none is named twice.
    once = F.when(F.size(F.array_distinct(own["id"])) == F.size(own), own).otherwise(first)
    keyed = F.sort_array(F.transform(once, lambda r: F.struct((~r["is_primary"]).alias("a"), r["name"].alias("b"), r["id"].alias("c"), r.alias("r"))))
    return F.transform(keyed, lambda x: x["r"])


def ordered_relations(rel: Column) -> Column:
    """Current, issuing, primary, then by name (K4)."""
    keyed = F.sort_array(F.transform(rel, lambda r: F.struct((~r["is_current"]).alias("a"), (~is_issuing(r["relationship"])).alias("b"), (~r["is_primary"]).alias("c"), r["name"].alias("d"), r["id"].alias("e"), r.alias("r"))))
    return F.transform(keyed, lambda x: x["r"])


def former_issuers(rel: Column) -> Column:
    """Past issuers, the most recently ended first, those without an end last, then by name."""
    own = F.filter(rel, lambda r: (r["relationship"] == "former_issuer") | (is_issuing(r["relationship"]) & ~r["is_current"]))
    keyed = F.array_sort(F.transform(own, lambda r: F.struct(r["effective_to"].isNull().alias("a"), (-F.unix_micros(r["effective_to"])).alias("b"), r["name"].alias("c"), r["id"].alias("d"), r.alias("r"))))
    return F.transform(keyed, lambda x: x["r"])


def _fold(claims: Column) -> Column:
    """Fold claims pairwise; struct(best, resolution, stopped). Stops for good at the first undecided pair (K6)."""
    start = F.struct(claims[0].alias("best"), F.lit("unresolved").alias("resolution"), F.lit(False).alias("stopped"))

    def step(acc: Column, c: Column) -> Column:
        b = acc["best"]
        dated = b["effective_from"].isNotNull() & c["effective_from"].isNotNull() & (b["effective_from"] != c["effective_from"])
        gap = F.abs(b["confidence"] - c["confidence"]) >= CONFIDENCE_MARGIN

        def by(rule: str, takes: Column) -> Column:
            return F.struct(F.when(takes, c).otherwise(b).alias("best"), F.lit(rule).alias("resolution"), F.lit(False).alias("stopped"))

        return (
            F.when(acc["stopped"] | (b["id"] == c["id"]), acc)
            .when(b["neg"] != c["neg"], by("more_specific", c["neg"] < b["neg"]))
            .when(dated, by("later_effective_date", c["effective_from"] > b["effective_from"]))
            .when(b["span"] != c["span"], by("narrower_range", c["span"] < b["span"]))
            .when(gap, by("better_evidenced", c["confidence"] > b["confidence"]))
            .otherwise(F.struct(b.alias("best"), F.lit("unresolved").alias("resolution"), F.lit(True).alias("stopped")))
        )

    return F.aggregate(F.slice(claims, 2, F.greatest(F.size(claims) - 1, F.lit(0))), start, step)


def _settled(claims: Column, done: Column) -> Column:
    """struct(resolution, winner id) of claims, with what :func:`_fold` made of them (K6)."""
    several = F.size(F.array_distinct(claims["id"])) > 1
    return F.when(~several, F.struct(F.lit("same_institution").alias("resolution"), claims[0]["id"].alias("winner"))).otherwise(
        F.struct(done["resolution"].alias("resolution"), F.when(done["resolution"] != "unresolved", done["best"]["id"]).alias("winner"))
    )


def _met(asked: DataFrame, bins: DataFrame, ranges: DataFrame, cover: DataFrame, held: DataFrame) -> DataFrame:
    """(q, prefixes, _rest, *cover): what each distinct query meets; :func:`_with_first` then completes its prefixes.

    ``prefixes`` lists the prefixes that contain it, best first, without relationships. The first one's
    are met last, where they are, and are never moved: most queries have no other. ``_rest`` are the
    other prefixes with theirs.
    """
    found = prefix_candidates(asked.withColumn("query_id", F.col("q")), bins, "is_current")
    own = found.groupBy("q").agg(F.sort_array(F.collect_list(_prefix_struct())).alias("prefixes"))
    rest = own.where(F.size("prefixes") > 1).select("q", F.explode(F.slice("prefixes", F.lit(2), F.size("prefixes") - 1)).alias("p"))
    rest = rest.join(held, F.col("p.id") == F.col("bin_id"), "left")
    rest = rest.groupBy("q").agg(F.sort_array(F.collect_list(_related(F.col("p"), held))).alias("_rest"))
    both = own.join(rest, "q", "left").join(_intervals(asked, ranges), "q", "full")
    return both.join(cover, F.col("at") == F.col("start"), "left").drop("at", "start")


def _related(p: Column, held: DataFrame) -> Column:
    none = F.array().cast(held.schema["relations"].dataType)
    return F.struct(*[p[n].alias(n) for n in ("neg", "span", "past", "bin", "kind", "id", "strategy")], F.coalesce("relations", none).alias("relations"))


def _beside_first(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` of :func:`_met` with what ``held`` (bin_id, ...) knows of their first prefix. Rows without a prefix are dealt to any task."""
    keyed = rows.withColumn("_key", F.coalesce(F.get("prefixes", F.lit(0))["id"], F.xxhash64("q")))
    return keyed.join(held, (F.col("_key") == F.col("bin_id")) & F.col("prefixes").isNotNull(), "left").drop("_key", "bin_id")


def _with_first(rows: DataFrame, held: DataFrame) -> DataFrame:
    """``rows`` of :func:`_met` with ``prefixes`` and their relationships."""
    one = F.array(_related(F.get("prefixes", F.lit(0)), held))
    every = F.when(F.col("prefixes").isNull(), F.slice(one, 1, 0)).when(F.col("_rest").isNull(), one).otherwise(F.concat(one, F.col("_rest")))
    return _beside_first(rows, held).withColumn("prefixes", every).drop("_rest", "relations")


def _score(r: Column, strategy: Column, neg: Column, past: Column, backing: Column) -> Column:
    """How well a relationship is supported that ``backing`` other allocations name (K7, K8); never less for more of them."""
    s = _pick(strategy, BASE_SCORE) + F.least(F.lit(0.04), F.lit(0.02) * backing)
    s = s - F.when(is_issuing(r["relationship"]), 0.0).otherwise(0.12) - F.when(r["is_current"] & ~past, 0.0).otherwise(0.10)
    s = s - F.when(-neg <= SPECIFICITY["root_prefix"], 0.08).otherwise(0.0)
    s = F.when(r["confidence"].isNotNull(), F.least(s, F.greatest(F.lit(0.05), r["confidence"]))).otherwise(s)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), s))


def _unbacked(strategy: str) -> Column:
    """The best score of ``relations`` of a prefix that answers by ``strategy``, if nothing else names any of them."""
    past = ~F.coalesce(F.exists("relations", lambda r: r["is_current"]), F.lit(True))
    return F.array_max(F.transform("relations", lambda r: _score(r, F.lit(strategy), F.lit(-SPECIFICITY[strategy]), past, F.lit(0))))


def evidence(queries: DataFrame, bins: DataFrame, ranges: DataFrame, links: DataFrame, institutions: DataFrame) -> DataFrame:
    """All that is known of each distinct query that anything answers.

    ``prefixes`` lists the prefixes that contain it, best first; ``relations``, ``issuers`` and the scores ``root`` and ``exact``
    are of the first, made once a prefix; ``rest`` are the others with their relationships; then there is
    :func:`range_cover` of its interval.
    """
    named = relations(links, institutions)
    current = _current(bins.select("id", "bin", "span_low", "span_high"), named.select("bin_id", F.exists("relations", lambda r: r["is_current"]).alias("_any")))
    met = _met(queries.select("q").distinct(), current, ranges, range_cover(ranges, institutions), named).where("prefixes is not null or best is not null")
    held = named.select("bin_id", "relations", current_issuers(F.col("relations")).alias("issuers"), _unbacked("root_prefix").alias("root"), _unbacked("exact_6_digit").alias("exact"))
    rows = _beside_first(met, held)

    def some(name: str, of: str | None = None) -> Column:
        return F.coalesce(of or name, F.array().cast(rows.schema[of or name].dataType)).alias(name)

    return rows.select("q", some("prefixes"), some("rest", "_rest"), some("relations"), some("issuers"), "root", "exact", "best", F.coalesce("ranges", F.lit(0)).alias("ranges"), some("holders"))


def resolve(queries: DataFrame, bins: DataFrame, ranges: DataFrame, links: DataFrame, institutions: DataFrame) -> DataFrame:
    """The whole answer per query: winner, relationships with scores, conflicts and confidence (K3-K9)."""
    return queries.select("query_id", "q").join(answers(queries, bins, ranges, links, institutions), "q")


def answers(queries: DataFrame, bins: DataFrame, ranges: DataFrame, links: DataFrame, institutions: DataFrame) -> DataFrame:
    """:func:`resolve` of distinct queries (q). Who needs little of it selects that before it is met by each query."""
    rows = evidence(queries, bins, ranges, links, institutions)
    rows = rows.withColumn("w", F.least(F.get("prefixes", F.lit(0)), _range_struct(F.col("best"), False)))
    by_range = F.col("w.kind") == "range"
    of_range = _range_relations(F.col("best"))

    # What names the relationships of a winning prefix beside it: an institution that nothing else names scores as it always does.
    rows = rows.withColumn("backers", F.array_distinct(F.concat(F.col("holders")["id"], F.flatten(F.transform("rest", lambda c: c["relations"]["id"])))))

    def score(r: Column) -> Column:
        held = F.coalesce(F.get(F.filter("holders", lambda h: h["id"] == r["id"]), F.lit(0))["n"], F.lit(0))
        backing = F.size(F.filter("rest", lambda c: F.exists(c["relations"], lambda x: x["id"] == r["id"]))) + held
        backing = backing + F.when(by_range, F.when(F.exists("relations", lambda x: x["id"] == r["id"]), 0).otherwise(-1)).otherwise(0)
        return _score(r, F.col("w.strategy"), F.col("w.neg"), F.col("w.past"), backing)

    scored = F.transform(ordered_relations(F.when(by_range, of_range).otherwise(F.col("relations"))), lambda r: r.withField("score", score(r)))
    rows = rows.withColumn("relationships", scored)
    alone = F.when(~by_range, F.when(F.col("w.strategy") == "root_prefix", F.col("root")).otherwise(F.col("exact")))
    backed = F.when(by_range, of_range).otherwise(F.filter("relations", lambda r: F.array_contains("backers", r["id"])))
    rows = rows.withColumn("score", F.greatest(alone, F.array_max(F.transform(backed, score))))
    rows = rows.withColumn("named", F.when(by_range, F.size(of_range)).otherwise(F.size("relations"))).withColumn("first", F.when(by_range, F.col("issuers")))
    rows = rows.withColumn("issuers", F.when(by_range, current_issuers(of_range)).otherwise(F.col("issuers")))
    rows = rows.withColumn("who", F.col("issuers")["id"])

    def claim(neg: Column, span: Column, past: Column, bin: Column, id: Column, place: Column, who: Column, confidence: Column, since: Column) -> Column:
        return F.struct(neg.alias("neg"), span.alias("span"), past.alias("past"), bin.alias("bin"), id.alias("allocation"), place.cast("int").alias("place"), who.alias("id"), F.coalesce(confidence, F.lit(0.5)).alias("confidence"), since.alias("effective_from"))

    def claims_of(c: Column, issuers: Column) -> Column:
        return F.transform(issuers, lambda r, i: claim(c["neg"], c["span"], c["past"], c["bin"], c["id"], i, r["id"], r["confidence"], r["effective_from"]))

    # What the other allocations claim, in their order: each prefix's issuers, and each institution's best current range.
    # No range is as specific as a prefix, so the winner is contradicted by its own kind only; what the other kind
    # claims is made where there is something to settle.
    by_rest = F.when(F.size("rest") > 0, F.flatten(F.transform("rest", lambda c: claims_of(c, current_issuers(c["relations"])))))
    claimed = F.filter("holders", lambda h: h["claim"].isNotNull())
    by_ranges = F.transform(claimed, lambda h: claim(h["claim"]["neg"], h["claim"]["span"], h["claim"]["past"], F.col("q"), h["claim"]["id"], F.lit(0), h["id"], h["claim"]["confidence"], h["claim"]["effective_from"]))
    rows = rows.withColumn("alike", F.sort_array(F.when(by_range, by_ranges).otherwise(by_rest)))
    contradicting = F.filter("alike", lambda c: (c["neg"] == F.col("w.neg")) & ~F.array_contains("who", c["id"]))["id"]
    rivals = F.concat(F.slice("who", 2, F.greatest(F.size("who") - 1, F.lit(1))), F.coalesce(contradicting, F.array().cast("array<bigint>")))
    # An allocation without relationships says nothing that could be contradicted.
    rows = rows.withColumn("rivals", F.when(F.col("named") > 0, F.array_distinct(rivals)).otherwise(F.array().cast("array<bigint>")))
    some = F.size("rivals") > 0
    prefixed = F.concat(claims_of(F.get("prefixes", F.lit(0)), F.col("first")), F.coalesce(by_rest, F.slice(claims_of(F.col("w"), F.col("issuers")), 1, 0)))
    unlike = F.when(by_range, prefixed).otherwise(by_ranges)
    others = F.sort_array(F.when(F.col("alike").isNull(), unlike).otherwise(F.concat("alike", unlike)))
    # An issuer of the winner claims once, and before all others.
    more = F.filter(others, lambda c: ~F.array_contains("who", c["id"]))
    rows = rows.withColumn("more", F.when(some, more))
    firsts = F.filter("more", lambda c, i: F.array_position(F.col("more")["id"], c["id"]) == i + 1)
    firsts = F.when(F.size(F.array_distinct(F.col("more")["id"])) == F.size("more"), F.col("more")).otherwise(firsts)
    rows = rows.withColumn("claims", F.when(some, F.concat(claims_of(F.col("w"), F.col("issuers")), firsts)))
    rows = rows.withColumn("folded", F.when(some, _fold(F.col("claims"))))
    rows = rows.withColumn("settled", F.when(some, _settled(F.col("claims"), F.col("folded"))))
    # Nothing to settle where the winner's own issuers don't compete: then there is no conflict at all.
    open_rivals = F.when((F.size("rivals") > 0) & (F.col("settled.resolution") == "unresolved"), F.size("rivals")).otherwise(0)
    rows = rows.withColumn("conflicts", open_rivals)

    best = F.col("score")
    level = (
        F.when(F.col("named") == 0, "unknown")
        .when(F.col("conflicts") > 0, "conflicted")
        .when(best >= 0.95, "verified")
        .when(best >= 0.82, "high")
        .when(best >= 0.60, "medium")
        .when(best > 0, "low")
        .otherwise("unknown")
    )
    return rows.select(
        "q",
        F.col("w.kind").alias("kind"),
        F.col("w.id").alias("id"),
        F.col("w.bin").alias("bin"),
        F.col("w.strategy").alias("strategy"),
        (-F.col("w.neg")).alias("specificity"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
        level.alias("level"),
        "rivals",
        "conflicts",
        F.col("settled.resolution").alias("resolution"),
        F.col("settled.winner").alias("settled_for"),
        "named",
        "relationships",
        (F.size("prefixes") + F.col("ranges") - 1).alias("others"),
    )


def agreement(queries: DataFrame, bins: DataFrame, ranges: DataFrame, links: DataFrame, institutions: DataFrame) -> DataFrame:
    """(query_id, institution_id, candidates): how many allocations that contain a query name each institution."""
    known = institutions.select(F.col("id").alias("_i"))
    held = links.join(known, F.col("institution_id") == F.col("_i")).groupBy("bin_id").agg(F.collect_set(F.col("institution_id").cast("bigint")).alias("relations"))
    cover = range_cover(ranges, institutions, claims=False)
    met = _met(queries.select("q").distinct(), bins.withColumn("is_current", F.lit(True)), ranges, cover, held)
    # Counts are made where a query meets its prefix, in its row, and are never moved.
    rows = _with_first(queries.select("query_id", "q").join(met, "q"), held)
    holders = F.coalesce("holders", F.array().cast(rows.schema["holders"].dataType))
    numbers = F.map_from_arrays(holders["id"], holders["n"])
    every = F.array_distinct(F.concat(F.flatten(F.col("prefixes")["relations"]), holders["id"]))

    def count(i: Column) -> Column:
        naming = F.filter("prefixes", lambda c: F.array_contains(c["relations"], i))
        return F.struct(i.alias("institution_id"), (F.size(naming) + F.coalesce(F.try_element_at(F.col("numbers"), i), F.lit(0))).cast("bigint").alias("candidates"))

    rows = rows.select("query_id", "prefixes", numbers.alias("numbers"), every.alias("every"))
    return rows.select("query_id", F.explode(F.transform("every", count)).alias("e")).select("query_id", "e.*")


def match_label(strategy: Column, length: Column) -> Column:
    """How the winner was reached, naming the length that matched."""
    names = {"exact_8_digit": "Exact 8-digit", "exact_assigned_bin": "Exact 8-digit", "account_range": "Account range", "exact_6_digit": "Exact 6-digit", "broader_range": "Broader range"}
    return F.when(strategy == "root_prefix", F.concat(length.cast("string"), F.lit("-digit prefix"))).otherwise(F.coalesce(_pick(strategy, names), F.lit("No match")))


def more_specific(queries: DataFrame, bins: DataFrame, most: int = 200) -> DataFrame:
    """(query_id, more_specific): longer prefixes below each short query; the report saturates at ``most``."""
    found = children_join(queries, bins.select("bin")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.join(found, "query_id", "left").select("query_id", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).alias("more_specific"))
