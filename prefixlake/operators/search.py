"""Search over prefixes: row projection, criteria, scopes, ranking and paging."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.functions.digits import clean_digits, high, low, starts_between

SORTABLE = ("bin", "network", "country", "card_type", "funding_type", "institution", "status", "first_seen")
MAX_PAGE = 1000


def contains_text(c: Column, needle: str) -> Column:
    """Case-blind containment; ``%`` and ``_`` of the needle stand for themselves."""
    return F.lower(c).contains(needle.lower())


def label(c: Column) -> Column:
    """``deferred_debit`` as ``Deferred Debit``; unknown and null have none."""
    return F.when(c.isNull() | (c == "unknown"), F.lit(None)).otherwise(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def is_blank_label(c: Column) -> Column:
    """Whether a display value says that nothing is known."""
    return c.isNull() | F.lower(F.trim(c)).isin("", "-", "--", "n/a", "na", "null", "none", "unknown", "?")


def primary_links(links: DataFrame, only_primary: bool = True) -> DataFrame:
    """(bin_id, inst_id, is_current, relationship_type): three separate aggregates over a prefix's links."""
    own = links.where("is_primary") if only_primary else links
    return own.groupBy("bin_id").agg(F.min("institution_id").alias("inst_id"), F.max("is_current").alias("is_current"), F.min("relationship_type").alias("relationship_type"))


def first_addresses(addresses: DataFrame) -> DataFrame:
    """(inst_id, region, city, address_country_id): the address of least id of each institution."""
    best = addresses.groupBy("institution_id").agg(F.min_by(F.struct("region", "city", "country_id"), "id").alias("a"))
    return best.select(F.col("institution_id").alias("inst_id"), "a.region", "a.city", F.col("a.country_id").alias("address_country_id"))


def rows(bins: DataFrame, networks: DataFrame, countries: DataFrame, links: DataFrame, institutions: DataFrame, addresses: DataFrame, only_primary: bool = True) -> DataFrame:
    """One row per prefix with everything a table shows (P1, J1). Dimensions are small enough for the planner to broadcast."""
    net = networks.select(F.col("id").alias("network_id"), F.col("code").alias("network_code"), F.col("display_name").alias("network"))
    land = countries.select(F.col("id").alias("country_id"), F.col("iso2").alias("country_code"), F.col("name").alias("country"), F.col("currency_code").alias("country_currency"))
    inst = institutions.select(F.col("id").alias("inst_id"), F.col("uid").alias("institution_uid"), F.col("display_name").alias("institution"))
    link = primary_links(links, only_primary).withColumnRenamed("bin_id", "id")
    out = bins.join(net, "network_id", "left").join(land, "country_id", "left").join(link, "id", "left")
    out = out.join(inst, "inst_id", "left").join(first_addresses(addresses), "inst_id", "left")
    return out.withColumn("is_current", F.coalesce("is_current", F.lit(True)))


@dataclass(frozen=True)
class AdvancedQuery:
    """Optional criteria; all that are given must hold."""

    bin_prefix: str | None = None
    bin_from: str | None = None
    bin_to: str | None = None
    network_code: str | None = None
    card_type: str | None = None
    funding_type: str | None = None
    status: str | None = None
    prepaid: bool | None = None
    commercial: bool | None = None
    country_code: str | None = None
    region: str | None = None
    city: str | None = None
    institution: str | None = None
    institution_match: str = "contains"
    seen_after: str | None = None
    seen_before: str | None = None

    @property
    def is_empty(self) -> bool:
        return not self.describe()

    def describe(self) -> list[str]:
        """Stable labels of the given criteria, fit for a cache key."""
        names = [n for n in self.__dataclass_fields__ if n != "institution_match"]
        return [f"{n.replace('_', ' ')}: {v}" for n in names if (v := getattr(self, n)) not in (None, "")]

    def conditions(self) -> list[Column]:
        """Predicates on :func:`rows`; those on stored columns reach the scan."""
        out: list[Column] = []
        if self.bin_prefix:
            out.append(starts_between(F.col("span_low"), "".join(x for x in self.bin_prefix if x in "0123456789")))
        if self.bin_from:
            out.append(F.col("span_low") >= low(clean_digits(F.lit(self.bin_from))))
        if self.bin_to:
            out.append(F.col("span_low") <= high(clean_digits(F.lit(self.bin_to))))
        for name in ("network_code", "card_type", "funding_type", "status"):
            if (v := getattr(self, name)) is not None:
                out.append(F.col(name) == v)
        if self.prepaid is not None:
            out.append(F.col("is_prepaid").eqNullSafe(F.lit(self.prepaid)))
        if self.commercial is not None:
            out.append(F.col("is_commercial").eqNullSafe(F.lit(self.commercial)))
        if self.country_code:
            out.append(F.col("country_code") == self.country_code.upper())
        if self.region:
            out.append(contains_text(F.col("region"), self.region.strip()))
        if self.city:
            out.append(contains_text(F.col("city"), self.city.strip()))
        if self.seen_after:
            out.append(F.col("first_seen") >= F.lit(self.seen_after).cast("timestamp"))
        if self.seen_before:
            out.append(F.col("first_seen") <= F.lit(self.seen_before).cast("timestamp"))
        return out


@dataclass(frozen=True)
class TableFilters:
    """The quick filters of a table (P6). ``is_current`` false also takes rows that don't say."""

    country_code: str | None = None
    network_code: str | None = None
    card_type: str | None = None
    funding_type: str | None = None
    region: str | None = None
    prefix_length: int | None = None
    is_current: bool | None = None
    text: str | None = None
    extra: tuple = field(default=())

    def conditions(self) -> list[Column]:
        names = ("country_code", "network_code", "card_type", "funding_type", "region", "prefix_length")
        out = [F.col(n) == v for n in names if (v := getattr(self, n)) is not None]
        if self.is_current is not None:
            out.append(F.col("is_current") if self.is_current else ~F.coalesce("is_current", F.lit(False)))
        if self.text:
            out.append(F.col("bin").startswith(self.text) | contains_text(F.col("institution"), self.text) | contains_text(F.col("city"), self.text))
        return out


def where_all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def matching_institutions(institutions: DataFrame, aliases: DataFrame | None, needle: str, mode: str, term: str | None = None) -> DataFrame:
    """Distinct ids whose normalised names or aliases match (P11, U1, J13); contains also looks at display names."""

    def test(c: Column) -> Column:
        return c == needle if mode == "exact" else c.startswith(needle) if mode == "prefix" else c.contains(needle)

    named = test(F.col("normalized_name"))
    if mode == "contains":
        named = named | contains_text(F.col("display_name"), term or needle)
    found = institutions.where(named).select("id")
    if aliases is not None:
        found = found.union(aliases.where(test(F.col("normalized_alias"))).select("institution_id"))
    return found.distinct()


def by_institutions(df: DataFrame, links: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows linked in any way to the institutions ``ids``."""
    linked = links.join(ids.withColumnRenamed("id", "institution_id"), "institution_id", "left_semi").select(F.col("bin_id").alias("id"))
    return df.join(linked, "id", "left_semi")


def scope(bins: DataFrame, query: AdvancedQuery, networks: DataFrame, countries: DataFrame, links: DataFrame, institutions: DataFrame, addresses: DataFrame) -> DataFrame:
    """The prefixes that analytics counts for a query: institution by containment, geography over any link and any address."""
    plain = AdvancedQuery(**{n: getattr(query, n) for n in query.__dataclass_fields__ if n not in ("network_code", "country_code", "region", "city", "institution", "institution_match")})
    out = where_all(bins, plain.conditions())
    if query.network_code:
        out = out.join(networks.where(F.col("code") == query.network_code).select(F.col("id").alias("network_id")), "network_id", "left_semi")
    if query.country_code:
        out = out.join(countries.where(F.col("iso2") == query.country_code.upper()).select(F.col("id").alias("country_id")), "country_id", "left_semi")
    if query.institution:
        out = by_institutions(out, links, matching_institutions(institutions, None, query.institution.lower(), "contains", query.institution))
    places = [contains_text(F.col(n), v) for n, v in (("region", query.region), ("city", query.city)) if v]
    if places:
        out = by_institutions(out, links, where_all(addresses, places).select(F.col("institution_id").alias("id")).distinct())
    return out


def page(df: DataFrame, sort_by: str = "bin", descending: bool = False, page: int = 1, size: int = 50) -> DataFrame:
    """One page in a total order: nulls first when ascending, ties by prefix (L1, L2). Unknown sort columns fall back."""
    column = F.col(sort_by if sort_by in SORTABLE and sort_by in df.columns else "bin")
    order = column.desc_nulls_last() if descending else column.asc_nulls_first()
    size = max(1, min(MAX_PAGE, size))
    return df.orderBy(order, F.col("bin").asc(), F.col("id").asc()).offset((max(1, page) - 1) * size).limit(size)


def page_info(total: int, page: int, size: int) -> dict[str, int | bool]:
    """Page arithmetic (L3)."""
    pages = -(-total // size) if total else 0
    first = (page - 1) * size + 1 if total and page <= pages else 0
    return {"total": total, "pages": pages, "first": first, "last": min(total, page * size) if first else 0, "has_next": page < pages, "has_previous": page > 1}


def search_institutions(institutions: DataFrame, needle: str, core: str, limit: int = 25, aliases: DataFrame | None = None) -> DataFrame:
    """Ranked institutions: exact name, alias, prefix, core prefix, containment."""
    name = F.col("normalized_name")
    hit = F.lit(False)
    if aliases is not None:
        ids = aliases.where(F.col("normalized_alias").contains(needle)).select(F.col("institution_id").alias("id"), F.lit(True).alias("_alias")).distinct()
        institutions = institutions.join(ids, "id", "left")
        hit = F.coalesce("_alias", F.lit(False))
    rank = F.when(name == needle, 0).when(hit, 2).when(name.startswith(needle), 3).when(name.startswith(core), 4).when(name.contains(needle), 5).otherwise(6)
    found = institutions.where(name.contains(needle) | contains_text(F.col("display_name"), needle) | hit).withColumn("rank", rank)
    return found.orderBy("rank", "display_name", "id").limit(min(limit, 100))


def suggestions(bins: DataFrame, links: DataFrame, institutions: DataFrame, term: str, limit: int = 8) -> DataFrame:
    """(kind, value, label): type-ahead on prefixes for three digits or more, else on names."""
    digits = "".join(x for x in term if x in "0123456789")
    if len(digits) >= 3:
        first = primary_links(links).select(F.col("bin_id").alias("id"), "inst_id")
        found = bins.where(F.col("bin").startswith(digits)).orderBy("bin", "id").limit(limit).join(first, "id", "left")
        found = found.join(institutions.select(F.col("id").alias("inst_id"), "display_name"), "inst_id", "left")
        return found.select(F.lit("bin").alias("kind"), F.col("bin").alias("value"), F.concat("bin", F.lit(" · "), F.coalesce("display_name", F.lit("Unknown issuer"))).alias("label"))
    found = institutions.where(F.col("normalized_name").contains(term.lower())).orderBy("display_name", "id").limit(limit)
    return found.select(F.lit("institution").alias("kind"), F.col("uid").alias("value"), F.col("display_name").alias("label"))


def merge_palette(entries: list[DataFrame], limit: int) -> DataFrame:
    """One ranked list from several (kind, value, label, rank) sources, best entry of each (kind, value) kept."""
    every = entries[0]
    for e in entries[1:]:
        every = every.unionByName(e)
    best = every.groupBy("kind", "value").agg(F.min(F.struct("rank", "label")).alias("b"))
    return best.select("kind", "value", "b.label", "b.rank").orderBy("rank", "kind", "value").limit(limit)


def filter_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value): the distinct known values of each column in one pass (U4)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").distinct()


def newest(df: DataFrame, key: list[str], order: Column, keep: int) -> DataFrame:
    """The ``keep`` newest rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(F.col("_n") <= keep).drop("_n")
