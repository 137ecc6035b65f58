"""Institution names: normal forms, similarity and match scores.

Normal forms are column expressions. Only the sequence ratio is Python, as an Arrow-batched function
that callers apply to distinct pairs.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from prefixlake.functions.text import clean_display, collapse, initialism, squash, strip_accents

# Legal forms, words that don't discriminate, abbreviations, and generic words.
LEGAL_SUFFIXES = (
    "national association", "n a", "na", "nat assn", "incorporated", "inc", "corporation", "corp", "company", "co",
    "limited", "ltd", "llc", "llp", "lp", "plc", "pllc", "public limited company", "public joint stock company", "pjsc", "jsc",
    "société anonyme", "societe anonyme", "sa", "s a", "sas", "sarl", "sasu", "aktiengesellschaft", "ag", "gmbh", "kgaa", "se",
    "naamloze vennootschap", "nv", "n v", "bv", "b v", "aktiebolag", "ab", "as", "asa", "oyj", "oy", "aps",
    "spa", "s p a", "srl", "s r l", "sapi de cv", "sa de cv", "sab de cv", "pte", "pte ltd", "sdn bhd", "bhd", "tbk", "pt",
    "ojsc", "zao", "pao", "ooo", "cooperative", "co operative", "coop", "holdings", "holding", "group", "groupe", "gruppo", "grupo", "bankaktiengesellschaft",
)
STOPWORDS = ("the", "of", "and", "for", "a", "an", "de", "la", "le", "el", "du", "der", "die", "das", "van", "von", "di", "del")
ABBREVIATIONS = {
    "cu": "credit union", "fcu": "federal credit union", "cus": "credit union", "nb": "national bank", "natl": "national", "nat": "national",
    "intl": "international", "int": "international", "sb": "savings bank", "svgs": "savings", "svcs": "services", "svc": "service",
    "fin": "financial", "fincl": "financial", "fed": "federal", "mut": "mutual", "assn": "association", "assoc": "association",
    "coop": "cooperative", "bk": "bank", "bnk": "bank", "bcp": "bancorp", "tr": "trust", "mgmt": "management", "hldgs": "holdings", "grp": "group",
}
GENERIC = (
    "bank", "banco", "banque", "banca", "bankas", "banka", "bancorp", "credit", "union", "savings", "trust", "financial", "finance",
    "national", "international", "federal", "state", "first", "commercial", "cooperative", "mutual", "card", "cards", "services", "solutions",
    "payments", "payment", "sparkasse", "raiffeisen", "volksbank",
)
# Fixed value: words that name a place of business, not the institution.
BRANCH_WORDS = r"\b(branch|bank branch|head office|main office|hq|headquarters|division|dept|department)\b"

MERGE, REVIEW, GENERIC_WEIGHT = 0.92, 0.78, 0.35

_LEGAL = "|".join(re.escape(s).replace("\\ ", " ") for s in sorted(LEGAL_SUFFIXES, key=len, reverse=True))


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def name_struct(c: Column) -> Column:
    """struct(display, normalized, core, acronym) of a raw institution name."""
    display = clean_display(c)
    base = collapse(F.regexp_replace(squash(display), BRANCH_WORDS, " "))
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    words = F.transform(F.filter(F.split(base, " "), lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(table, t), t))
    normalized = F.regexp_replace(F.array_join(words, " "), r"(?U)(?<=\b\p{L}) (?=\p{L}\b)", "")
    stripped = F.regexp_replace(normalized, rf"^(.+?)(?: (?:{_LEGAL}))+$", "$1")
    kept = F.filter(F.split(stripped, " "), lambda t: ~F.array_contains(_words(STOPWORDS), t) & (t != ""))
    core = F.array_join(kept, " ")
    return F.struct(display.alias("display"), normalized.alias("normalized"), F.when(core == "", base).otherwise(core).alias("core"), initialism(F.filter(F.split(stripped, " "), lambda t: t != "")).alias("acronym"))


def aliases(n: Column) -> Column:
    """Other spellings worth indexing, from a :func:`name_struct` column: no accents, core, acronym, ``&`` and and exchanged; distinct by comparison form."""
    display = n["display"]
    plain, words = strip_accents(display), F.split(n["core"], " ")
    options = F.array(
        F.when(plain != display, plain),
        F.when(n["core"] != n["normalized"], n["core"]),
        F.when((F.size(words) >= 3) & (F.length(n["acronym"]) >= 3), n["acronym"]),
        F.when(display.contains("&"), F.replace(display, F.lit("&"), F.lit("and"))).when(F.lower(display).contains(" and "), F.regexp_replace(display, r"(?i)\band\b", "&")),
    )
    keyed = F.transform(F.filter(options, lambda x: x.isNotNull()), lambda x: F.struct(squash(x).alias("k"), collapse(x).alias("v")))
    keyed = F.filter(keyed, lambda x: (x["k"] != "") & (x["k"] != squash(display)))
    return F.transform(F.filter(keyed, lambda x, i: F.forall(F.slice(keyed, F.lit(1), i), lambda y: y["k"] != x["k"])), lambda x: x["v"])


def host(c: Column) -> Column:
    """Host of a website without ``www.``; a missing scheme is supplied."""
    url = F.when(c.contains("//"), c).otherwise(F.concat(F.lit("https://"), c))
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings, in that order (M1); empty or null gives 0, equal 1."""
    return pd.Series([0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def token_overlap(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two token arrays, generic words counting less (M3)."""

    def weight(words: Column) -> Column:
        return F.aggregate(words, F.lit(0.0), lambda s, t: s + F.when(F.array_contains(_words(GENERIC), t), GENERIC_WEIGHT).otherwise(1.0))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(weight(F.array_intersect(a, b)) / weight(F.array_union(a, b)))


def similarity(a: Column, b: Column, literal: Column) -> Column:
    """Name similarity of two :func:`name_struct` values; ``literal`` is the ratio of their cores (M4)."""
    x, y = F.split(a["core"], " "), F.split(b["core"], " ")
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    prefix = F.when(F.slice(long, F.lit(1), F.size(short)) == short, 0.9).otherwise(0.0)
    acronym = F.when((a["acronym"] == "") | (b["acronym"] == ""), 0.0).when((a["acronym"] == b["acronym"]) & (F.length(a["acronym"]) >= 3), 0.75)
    acronym = acronym.when(a["acronym"] == F.upper(F.replace(b["core"], F.lit(" "), F.lit(""))), 0.7).otherwise(0.0)
    total = token_overlap(x, y) * 3.0 + literal * 2.0 + prefix * F.when(prefix > 0, 1.5).otherwise(0.0) + acronym * F.when(acronym > 0, 1.0).otherwise(0.0)
    weights = F.lit(5.0) + F.when(prefix > 0, 1.5).otherwise(0.0) + F.when(acronym > 0, 1.0).otherwise(0.0)
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weights))
    return F.when((a["normalized"] == "") | (b["normalized"] == ""), 0.0).when(a["normalized"] == b["normalized"], 1.0).when((a["core"] != "") & (a["core"] == b["core"]), 0.97).otherwise(mean)


def match(name_score: Column, same_country: Column, other_country: Column, same_swift: Column, shared: Column, same_host: Column, alias: Column, same_postal: Column) -> Column:
    """struct(score, can_merge, needs_review): evidence weighed as in M5."""
    base = F.when(alias, 1.0).otherwise(name_score) * F.when(other_country, 0.55).otherwise(1.0)
    boost = F.when(same_swift, 0.06).otherwise(0.0) + F.when(shared > 0, 0.04).otherwise(0.0) + F.when(same_host, 0.04).otherwise(0.0)
    score = F.least(F.lit(1.0), base + boost)
    signals = sum((F.when(x, 1).otherwise(0) for x in (same_country, shared > 0, same_host, same_swift, same_postal, alias)), F.lit(0))
    backed = same_swift | same_host | (shared > 0) | (signals >= 2)
    merge = (score >= MERGE) & backed
    return F.struct(score.alias("score"), merge.alias("can_merge"), (~merge & (score >= REVIEW)).alias("needs_review"))
