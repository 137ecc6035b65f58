"""Text forms as column expressions: accents, comparison forms, tokens, tidying."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 256


def _base(ch: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


# Every character below U+3000, and every full-width form, whose decomposition has one base character.
_FOLDED = {chr(i): b for r in (range(0xA0, 0x3000), range(0xFF01, 0xFF5F)) for i in r if len(b := _base(chr(i))) == 1 and b != chr(i)}
_FROM, _TO = "".join(_FOLDED), "".join(_FOLDED.values())


def strip_accents(c: Column) -> Column:
    """Decomposed, without combining marks (F6): one lookup per character, no Python."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}+", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends (F8)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def squash(c: Column) -> Column:
    """Comparison form: no accents, no punctuation, ``&`` as and, lower case (F7); null as empty."""
    plain = F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), r"(?U)\s*&\s*", " and ")
    return F.lower(collapse(F.regexp_replace(plain, r"(?U)[^\w\s]", " ")))


def sanitise(c: Column, limit: int = MAX_TEXT) -> Column:
    """No control characters, collapsed, bounded; nothing left is null (F8)."""
    kept = collapse(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    return F.nullif(F.substring(kept, 1, limit), F.lit(""))


def clean_display(c: Column) -> Column:
    """A name for display, without punctuation left at its ends (F8)."""
    return F.regexp_replace(F.coalesce(sanitise(c), F.lit("")), "^[ ,;:\\-–—]+|[ ,;:\\-–—]+$", "")


def tokens(c: Column) -> Column:
    """Words of the comparison form."""
    return F.filter(F.split(squash(c), " "), lambda t: t != "")


def initialism(words: Column) -> Column:
    """First letters, upper case."""
    return F.upper(F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), ""))


def uid(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first 24 hex digits of a hash of the parts."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])), 1, 24))


def fingerprint(*parts: Column) -> Column:
    """A hash of the parts' comparison forms."""
    return F.sha1(F.concat_ws("|", *[squash(p) for p in parts]))


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet never evaluates; plain numbers stay as they are."""
    return F.when(c.isNull(), "").when(c.rlike(r"^[=+\-@\t\r]") & c.try_cast("double").isNull(), F.concat(F.lit("'"), c)).otherwise(c)


def from_json_map(c: Column) -> Column:
    """A JSON object as a map of strings; anything else is null."""
    return F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})


def to_sorted_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
