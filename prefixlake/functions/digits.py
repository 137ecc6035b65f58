"""Digit strings: prefixes, ranges, checks and what the digits themselves say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_DIGITS, MAX_DIGITS = 4, 11
LIST_DIGITS = 8

# Published issuer identification ranges (scheme, first, last), in published order.
SCHEME_RANGES = (
    ("visa", "4", "4"),
    ("mastercard", "51", "55"),
    ("mastercard", "2221", "2720"),
    ("amex", "34", "34"),
    ("amex", "37", "37"),
    ("diners", "300", "305"),
    ("diners", "3095", "3095"),
    ("diners", "36", "36"),
    ("diners", "38", "39"),
    ("jcb", "3528", "3589"),
    ("jcb", "1800", "1800"),
    ("jcb", "2131", "2131"),
    ("discover", "6011", "6011"),
    ("discover", "622126", "622925"),
    ("discover", "644", "649"),
    ("discover", "65", "65"),
    ("unionpay", "62", "62"),
    ("mir", "2200", "2204"),
    ("uatp", "1", "1"),
)


def clean_digits(c: Column) -> Column:
    """Only the ASCII digits (F1)."""
    return F.regexp_replace(c, "[^0-9]", "")


def is_prefix(c: Column) -> Column:
    """Whether a cleaned value is a usable prefix: 4 to 11 digits; longer values are card numbers and refused."""
    return F.length(c).between(MIN_DIGITS, MAX_DIGITS)


def low(c: Column) -> Column:
    """First 8-digit value that starts with the digits (F2)."""
    return F.rpad(F.substring(c, 1, 8), 8, "0").cast("int")


def high(c: Column) -> Column:
    """Last 8-digit value that starts with the digits (F2)."""
    return F.rpad(F.substring(c, 1, 8), 8, "9").cast("int")


def prefix_parts(c: Column) -> dict[str, Column]:
    """Every derived column of a prefix (F2)."""
    n = F.length(c)
    return {
        "prefix_length": n,
        "prefix_type": F.when(n >= 8, "extended").otherwise("root"),
        "iin_length": F.when(n <= 7, 6).otherwise(8),
        "span_low": low(c),
        "span_high": high(c),
        "prefix6": F.rpad(F.substring(c, 1, 6), 6, "0"),
        "prefix8": F.rpad(F.substring(c, 1, 8), 8, "0"),
    }


def range_parts(a: Column, b: Column) -> dict[str, Column]:
    """A range from two digit strings: shorter ends padded, ends swapped if inverted, width at least 4."""
    width = F.greatest(F.length(a), F.length(b), F.lit(MIN_DIGITS))
    first, last = F.rpad(a, width, F.lit("0")), F.rpad(b, width, F.lit("9"))
    lo, hi = F.least(first, last), F.greatest(first, last)
    return {"range_low": lo, "range_high": hi, "range_low_int": low(lo), "range_high_int": high(hi), "width": width, "label": F.concat_ws("–", lo, hi)}


def list_prefix(c: Column, pad_short: bool = False, longest: int = LIST_DIGITS) -> Column:
    """struct(value, error) of a published list's prefix: 6 to ``longest`` digits; short ones padded on request.

    The error never repeats the value.
    """
    s = F.regexp_replace(F.trim(c), r"[\s-]", "")
    n = F.length(s)
    error = (
        F.when(c.isNull() | (s == ""), "blank")
        .when(s.rlike(r"(?i)^[0-9.]+e\+?[0-9]+$"), "scientific notation")
        .when(~s.rlike("^[0-9]+$"), "not digits")
        .when(n > longest, "too long")
        .when((n < 6) & F.lit(not pad_short), "too short")
    )
    padded = F.when(n < 6, F.lpad(s, 6, "0")).when(n == 7, F.lpad(s, 8, "0")).otherwise(s) if pad_short else s
    return F.struct(F.when(error.isNull(), padded).alias("value"), error.alias("error"))


def luhn_ok(c: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    digits = F.transform(F.split(F.reverse(c), ""), lambda x: F.try_to_number(x, F.lit("9")).cast("int"))
    digits = F.filter(digits, lambda x: x.isNotNull())
    doubled = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
    return (F.length(c) > 1) & (F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0)


def luhn_digit(c: Column) -> Column:
    """The check digit that completes the digits."""
    digits = F.transform(F.filter(F.split(F.reverse(c), ""), lambda x: x != ""), lambda x: x.cast("int"))
    doubled = F.transform(digits, lambda x, i: F.when(i % 2 == 1, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
    return (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10) % 10


def schemes(c: Column, ranges: tuple[tuple[str, str, str], ...] = SCHEME_RANGES) -> Column:
    """Every scheme whose published range covers the digits, narrowest range first."""
    found = []
    for scheme, first, last in sorted(ranges, key=lambda r: -len(r[1])):
        head = F.substring(c, 1, len(first))
        found.append(F.when((F.length(c) >= len(first)) & head.between(first, last), F.lit(scheme)))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def scheme_of(c: Column, ranges: tuple[tuple[str, str, str], ...] = SCHEME_RANGES, rest: bool = False) -> Column:
    """The one scheme that the digits establish, else null (F22). ``rest``: the last of ``ranges`` takes what none covers."""
    s = schemes(c, ranges)
    return F.when(F.size(s) == 1, s[0]).when(F.lit(rest) & (F.size(s) == 0), F.lit(ranges[-1][0]))


def _range_rule(scheme: str, first: str, last: str) -> str:
    return f"iin:{scheme}:{first}-{last}" if first != last else f"iin:{scheme}:{first}"


def scheme_rule(c: Column, ranges: tuple[tuple[str, str, str], ...] = SCHEME_RANGES, rest: bool = False) -> Column:
    """``iin:scheme:first-last`` of the range that settled :func:`scheme_of`."""
    rules = []
    for scheme, first, last in ranges:
        head = F.substring(c, 1, len(first))
        rules.append(F.when((F.length(c) >= len(first)) & head.between(first, last), F.lit(_range_rule(scheme, first, last))))
    if rest:
        rules.append(F.lit(_range_rule(*ranges[-1])))
    return F.when(scheme_of(c, ranges, rest).isNotNull(), F.coalesce(*rules))


def starts_between(value: Column, digits: str) -> Column:
    """A prefix predicate as a range over the padded integer, which reaches the scan."""
    return value.between(int(digits[:8].ljust(8, "0")), int(digits[:8].ljust(8, "9")))
