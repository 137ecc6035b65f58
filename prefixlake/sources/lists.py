"""Published prefix lists: commented, multi-section, self-describing text files.

A list is read as lines with their numbers; what a line is (comment, directive, header, data) is a
column. A line's meaning depends on those above it, yet a file is read by as many tasks as it has splits:
each split carries its own directives and headers forward, and tells in one row what it hands on; those
rows, one a split, are combined along the file, and every split gets what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixlake.functions.digits import LIST_DIGITS, list_prefix
from prefixlake.sources.readers import DELIMITERS

# Columns a list may have, and other names for them.
KNOWN = (
    "bin", "bin_high", "bank", "network", "brand", "card_type", "card_level", "funding_type", "prepaid", "commercial", "country", "country_alpha3", "country_name",
    "currency", "website", "phone", "city", "state", "postal_code", "status", "relationship", "effective_from", "effective_to", "notes", "latitude", "longitude", "accepted_in",
)
ALIASES = {
    "iin": "bin", "bin_number": "bin", "binnumber": "bin", "prefix": "bin", "bin_low": "bin", "range_low": "bin", "range_high": "bin_high", "bin_end": "bin_high",
    "issuer": "bank", "bank_name": "bank", "institution": "bank", "issuer_name": "bank", "issuing_bank": "bank", "emetteur": "bank", "émetteur": "bank", "banque": "bank",
    "scheme": "network", "card_scheme": "network", "marque": "network", "reseau": "network", "réseau": "network",
    "type": "card_type", "funding": "funding_type", "category": "card_level", "niveau": "card_level", "level": "card_level", "tier": "card_level", "product_level": "card_level", "card_category": "card_level",
    "country_code": "country", "iso_country": "country", "isocode2": "country", "iso_code2": "country", "alpha_2": "country", "alpha2": "country", "iso2": "country",
    "isocode3": "country_alpha3", "iso_code3": "country_alpha3", "alpha_3": "country_alpha3", "alpha3": "country_alpha3", "iso3": "country_alpha3",
    "countryname": "country_name", "country_label": "country_name", "pays": "country_name",
    "issuerurl": "website", "issuer_url": "website", "bank_url": "website", "url": "website", "homepage": "website",
    "issuerphone": "phone", "issuer_phone": "phone", "bank_phone": "phone", "telephone": "phone", "tel": "phone", "bank_city": "city",
    "comment": "notes", "note": "notes", "lat": "latitude", "lon": "longitude", "lng": "longitude",
}
DIRECTIVE = r"^#\s*[a-z]+:\s*([^=]+?)\s*=\s*(.+?)\s*$"
SCIENTIFIC = r"^[0-9.]+[eE]\+?[0-9]+$"
DEFAULT_CONFIDENCE = 0.9


def _canonical(c: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "^﻿", ""))), "[ _-]+", "_")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p]), name), name)


def _cells(line: Column, delimiter: Column) -> Column:
    """Cells of a line; delimiters inside quotes don't count, doubled quotes are one."""
    pattern = F.concat(F.lit("["), F.when(delimiter == "\t", "\\t").otherwise(delimiter), F.lit('](?=(?:[^"]*"[^"]*")*[^"]*$)'))
    return F.transform(F.split(line, pattern, -1), lambda x: F.trim(F.replace(F.regexp_replace(x, '^\\s*"|"\\s*$', ""), F.lit('""'), F.lit('"'))))


def _sniffed(line: Column) -> Column:
    """The delimiter that occurs most in a line."""
    counts = F.array(*[F.struct((F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, values, original, confidence, pad_short, unknown): every data row of the lists at ``path``.

    ``values`` maps canonical names to the first non-empty cell; ``original`` keeps the row under its
    own headers. ``unknown`` lists headers that no list may have: callers refuse such sections.
    """
    split, key = ["_path", "_block"], ["_path", "_block", "_id"]
    read = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", r"\r$", "").alias("text"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    # The id orders the lines of a split, which one task reads; it means nothing between splits.
    lines = read.withColumn("_id", F.monotonically_increasing_id())
    inside = Window.partitionBy(*split).orderBy("_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    comment = F.ltrim(F.regexp_replace("text", "^﻿", "")).startswith("#")
    said = F.when(comment & F.col("text").rlike("(?i)" + DIRECTIVE), F.struct(_canonical(F.regexp_extract("text", "(?i)" + DIRECTIVE, 1)).alias("k"), F.lower(F.regexp_extract("text", "(?i)" + DIRECTIVE, 2)).alias("v")))
    lines = lines.withColumn("_said", said).withColumn("_content", ~comment & (F.trim("text") != ""))
    lines = lines.withColumns({"_own_rules": F.collect_list("_said").over(upto), "_row": F.row_number().over(inside), "_own_n": F.count_if("_content").over(upto)})
    handed = lines.groupBy(*split).agg(
        F.count(F.lit(1)).alias("_lines"),
        F.count_if("_content").alias("_contents"),
        F.min_by("text", F.when(F.col("_content"), F.col("_id"))).alias("_first"),
        F.array_sort(F.collect_list(F.when(F.col("_said").isNotNull(), F.struct("_id", "_said")))).alias("_rules_here"),
    )
    handed = handed.select(
        *split,
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_lines_before"),
        F.coalesce(F.sum("_contents").over(before), F.lit(0)).alias("_contents_before"),
        F.flatten(F.collect_list(F.col("_rules_here")["_said"]).over(before)).alias("_rules_before"),
        F.first("_first", ignorenulls=True).over(whole).alias("_first"),
    )
    lines = lines.where("_content").join(handed, split)
    lines = lines.withColumn("line", (F.col("_lines_before") + F.col("_row")).cast("int")).withColumn("_n", F.col("_contents_before") + F.col("_own_n"))
    lines = lines.withColumn("_rules", F.concat("_rules_before", "_own_rules")).withColumn("_d", _sniffed(F.col("_first")))
    cells = _cells(F.col("text"), F.col("_d"))
    lines = lines.withColumn("cells", F.when(F.size(cells) > 1, cells).otherwise(_cells(F.col("text"), _sniffed(F.col("text")))))
    meanings = F.filter("_rules", lambda r: ~r["k"].isin("confidence", "pad_short_bins"))

    def named(c: Column) -> Column:
        """A header's meaning: what the file itself declares, else its canonical name."""
        own_rule = F.try_element_at(F.filter(meanings, lambda r: r["k"] == _canonical(c)), F.lit(-1))["v"]
        return F.coalesce(own_rule, _canonical(c))

    names = F.transform("cells", named)
    filled = F.filter("cells", lambda c: c != "")
    known = F.size(F.filter(filled, lambda c: _canonical(c).isin(*KNOWN) | F.exists("_rules", lambda r: r["k"] == _canonical(c))))
    digits = F.exists("cells", lambda c: F.regexp_replace(c, "[ -]", "").rlike("^[0-9]{3,}$"))
    header = (F.col("_n") == 1) | (~digits & (known >= 2) & (known * 2 >= F.size(filled)))
    lines = lines.withColumn("_head", F.when(header, F.struct(F.col("cells").alias("raw"), names.alias("names"))))
    lines = lines.select("file", "line", "cells", "_rules", "_head", *key)
    # The same once more for headers, whose names need the directives before them.
    handed = lines.groupBy(*split).agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("_id"))).alias("_last_head"))
    handed = handed.select(*split, F.last("_last_head", ignorenulls=True).over(before).alias("_head_before"))
    lines = lines.withColumn("_own_head", F.last("_head", ignorenulls=True).over(upto)).where("_head is null").join(handed, split)
    lines = lines.withColumn("_in", F.coalesce("_own_head", "_head_before"))
    zipped = F.arrays_zip(F.col("_in.names").alias("n"), F.col("_in.raw").alias("h"), F.col("cells").alias("c"))
    ordered = F.filter(zipped, lambda z: z["n"].isin(*KNOWN) & (F.coalesce(z["c"], F.lit("")) != ""))
    once = F.filter(ordered, lambda z, i: F.forall(F.slice(ordered, F.lit(1), i), lambda y: y["n"] != z["n"]))

    last = {k: F.try_element_at(F.filter("_rules", lambda r: r["k"] == k), F.lit(-1))["v"] for k in ("confidence", "pad_short_bins")}
    return lines.select(
        "file",
        "line",
        F.map_from_entries(F.transform(once, lambda z: F.struct(z["n"], z["c"]))).alias("values"),
        F.map_from_entries(F.array_distinct(F.transform(F.filter(zipped, lambda z: F.coalesce(z["h"], F.lit("")) != ""), lambda z: F.struct(z["h"], F.coalesce(z["c"], F.lit("")))))).alias("original"),
        F.coalesce(last["confidence"].try_cast("double"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        F.coalesce(last["pad_short_bins"].isin("true", "yes", "on", "1"), F.lit(False)).alias("pad_short"),
        F.filter("_in.names", lambda n: (n != "") & ~n.isin(*KNOWN)).alias("unknown"),
    )


def list_records(lines: DataFrame, longest: int = LIST_DIGITS) -> DataFrame:
    """One row per line: prefix of at most ``longest`` digits or error, the fields a record takes, and what is wrong."""
    v = {n: F.nullif(F.trim(F.try_element_at(F.col("values"), F.lit(n))), F.lit("")) for n in KNOWN}
    clean = {n: F.when(~F.coalesce(c.rlike(SCIENTIFIC), F.lit(False)), c) for n, c in v.items()}
    raw = F.coalesce(v["bin"], F.lit(""))
    found = F.when(F.col("pad_short"), list_prefix(raw, True, longest)).otherwise(list_prefix(raw, False, longest))
    level = F.lower(clean["card_level"])
    damaged = sum((F.when(v[n].rlike(SCIENTIFIC), 1).otherwise(0) for n in KNOWN if n != "bin"), F.lit(0))
    stripped = F.regexp_replace(raw, "[ -]", "")
    return lines.select(
        "file",
        "line",
        found["value"].alias("bin"),
        found["error"].alias("error"),
        clean["bank"].alias("issuer"),
        F.coalesce(clean["network"], clean["brand"]).alias("network"),
        clean["card_type"].alias("card_type"),
        clean["card_level"].alias("card_level"),
        F.coalesce(clean["country"], clean["country_alpha3"], clean["country_name"]).alias("country"),
        F.coalesce(clean["prepaid"], F.when(level.contains("prepaid") | level.contains("gift"), "true")).alias("prepaid"),
        F.coalesce(F.lower(clean["relationship"]), F.lit("issuer")).alias("relationship"),
        clean["effective_from"].alias("effective_from"),
        clean["effective_to"].alias("effective_to"),
        "confidence",
        (found["value"].isNotNull() & (F.length(stripped) != F.length(found["value"]))).alias("padded"),
        damaged.alias("damaged"),
        "original",
    )


def list_facts(records: DataFrame) -> DataFrame:
    """Accepted records without repeats: the last row of a fact at the place of the first."""
    from prefixlake.operators.pipeline import fact_dedup

    keyed = records.where("error is null").withColumn("_k", F.lower(F.regexp_replace(F.trim(F.coalesce("issuer", F.lit(""))), r"\s+", " ")))
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("effective_from", "effective_to")]
    keyed = keyed.select(*[c for c in keyed.columns if c not in ("effective_from", "effective_to")], *blank)
    return fact_dedup(keyed, ["bin", "_k", "relationship", "effective_from", "effective_to"], ["file", "line"]).drop("_k")


def list_report(records: DataFrame) -> DataFrame:
    """One row of counts over the lines of lists."""
    key = F.struct("bin", F.lower(F.coalesce("issuer", F.lit(""))), "relationship", "effective_from", "effective_to")
    facts = records.where("error is null")
    shared = facts.select("bin", F.lower(F.coalesce("issuer", F.lit(""))).alias("i"), "relationship").distinct().groupBy("bin").count().agg(F.count_if(F.col("count") > 1).alias("shared"))
    one = records.agg(
        F.count_if(F.col("error").isNull()).alias("read"),
        F.count_if(F.col("error").isNotNull()).alias("rejected"),
        F.countDistinct(F.when(F.col("error").isNull(), key)).alias("accepted"),
        F.countDistinct(F.when(F.col("error").isNull(), F.col("bin"))).alias("prefixes"),
        F.count_if(F.col("error") == "too short").alias("short"),
        F.count_if("padded").alias("padded"),
        F.count_if(F.col("error").isNull() & F.col("issuer").isNull()).alias("unnamed"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("damaged"))), F.lit(0)).alias("damaged"),
    )
    return one.join(F.broadcast(shared)).withColumn("duplicates", F.col("read") - F.col("accepted"))  # one row each


def archive(records: DataFrame, place: str) -> DataFrame:
    """Every source row as it was, kept once as a variant beside its prefix, place and error.

    Columns differ from list to list, so a row keeps its own headings; :func:`said` reads one of them.
    """
    rows = records.select("file", "line", "bin", "error", F.to_variant_object("original").alias("original"))
    rows.write.parquet(place)
    return records.sparkSession.read.parquet(place)


def said(heading: str) -> Column:
    """What an archived row says under one of its headings; null if it has none such."""
    path = heading.replace("'", "\\'")
    return F.try_variant_get("original", f"$['{path}']", "string")


def origin(records: DataFrame, prefix: str) -> DataFrame:
    """The rows that a prefix came from, in order (I18); ``records`` may be the archive."""
    return records.where(F.col("bin") == prefix).select("file", "line", "original").orderBy("file", "line")


def split_fused(rows: DataFrame, levels: DataFrame, banks: DataFrame, column: str = "text", rounds: int = 8) -> DataFrame:
    """``LEVEL BANK`` printed without a gap, split by two vocabularies that grow until nothing new is learnt.

    A row is split where its head is a known level or its tail a known bank; each split teaches the
    other half. Rows that no vocabulary settles keep a null level; head and tail always rebuild the text.
    """
    from prefixlake.session import checkpointed

    words = F.split(column, " ")
    cuts = rows.select(column, F.explode(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))).alias("n")).where(F.size(F.split(column, " ")) > 1)
    cuts = cuts.select(column, "n", F.array_join(F.slice(F.split(column, " "), F.lit(1), F.col("n")), " ").alias("level"), F.array_join(F.slice(F.split(column, " "), F.col("n") + 1, F.size(F.split(column, " "))), " ").alias("bank")).distinct()
    levels, banks, done = levels.toDF("level").distinct(), banks.toDF("bank").distinct(), -1
    for _ in range(rounds):
        hits = cuts.join(levels.withColumn("_l", F.lit(1)), "level", "left").join(banks.withColumn("_b", F.lit(1)), "bank", "left").where("_l is not null or _b is not null")
        best = checkpointed(hits.groupBy(column).agg(F.max_by(F.struct("level", "bank"), F.struct(F.coalesce("_b", F.lit(0)) + F.coalesce("_l", F.lit(0)), "n")).alias("s")).select(column, "s.*"))
        n = best.count()
        if n == done:
            break
        done, levels, banks = n, levels.union(best.select("level")).distinct(), banks.union(best.select("bank")).distinct()
    return rows.join(best, column, "left")
