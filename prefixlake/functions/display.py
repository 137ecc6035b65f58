"""Display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def period(start: Column, end: Column) -> Column:
    """``2020–2024``, ``Since 2020``, ``Until 2024`` or ``Unknown``."""
    a, b = F.year(start).cast("string"), F.year(end).cast("string")
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit("–"), b))
        .when(a.isNotNull(), F.concat(F.lit("Since "), a))
        .when(b.isNotNull(), F.concat(F.lit("Until "), b))
        .otherwise("Unknown")
    )


def number(c: Column) -> Column:
    """Whole number with thousands separators, else ``Unknown``."""
    return F.coalesce(F.format_number(c.cast("long"), 0), F.lit("Unknown"))


def size(c: Column) -> Column:
    """Bytes as B, KB, MB, GB, TB or PB."""
    out = F.concat(F.format_number(c / float(1 << 50), 1), F.lit(" PB"))
    for power, unit in ((40, "TB"), (30, "GB"), (20, "MB"), (10, "KB")):
        out = F.when(c < float(1 << (power + 10)), F.concat(F.format_string("%.1f", c / float(1 << power)), F.lit(f" {unit}"))).otherwise(out)
    out = F.when(c < 1024, F.concat(F.format_string("%.0f", c.cast("double")), F.lit(" B"))).otherwise(out)
    return F.when(c.isNull() | (c < 0), "Unknown").otherwise(out)


def duration(c: Column) -> Column:
    """``45s``, ``3m 20s`` or ``1h 05m``."""
    s = c.cast("long")
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lit("m"))
    minutes = F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(s.isNull() | (s < 0), "—").when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def relative(c: Column, now: Column) -> Column:
    """``just now``, ``3 hours ago``, ``in 2 days``."""
    delta = F.unix_timestamp(now) - F.unix_timestamp(c)
    away = F.abs(delta)
    out = F.when(delta < 0, "in a moment").otherwise("just now")
    for seconds, unit in ((60, "minute"), (3600, "hour"), (86400, "day"), (86400 * 7, "week"), (86400 * 30, "month"), (86400 * 365, "year")):
        n = F.floor(away / seconds)
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
        out = F.when(away >= seconds, F.when(delta < 0, F.concat(F.lit("in "), text)).otherwise(F.concat(text, F.lit(" ago")))).otherwise(out)
    return F.when(c.isNull(), "Never").otherwise(out)


def bin_groups(c: Column, most: int | None = None) -> Column:
    """A prefix grouped for reading: ``4147 2012`` (F27). Of ``most`` groups, the last takes all that is left."""
    if most is None:
        return F.when(F.length(c) <= 6, c).otherwise(F.trim(F.regexp_replace(c, "(.{4})", "$1 ")))
    head = 4 * (most - 1)
    grouped = F.trim(F.concat(F.regexp_replace(F.substring(c, 1, head), "(.{4})", "$1 "), F.substr(c, F.lit(head + 1))))
    return F.when(F.length(c) <= 6, c).otherwise(grouped)


def version_key(c: Column) -> Column:
    """A dotted version as a comparable array of struct(number, text) (F29); numbers sort before words of the same place."""
    parts = F.split(F.replace(c, F.lit("-"), F.lit(".")), r"\.")
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike("^[0-9]+$"), F.lit(0)).otherwise(1).alias("word"), F.coalesce(p.try_cast("long"), F.lit(0)).alias("n"), F.lower(p).alias("t")))


def version_compare(a: str, b: str) -> int:
    """-1, 0 or 1 for two dotted versions; missing parts count as 0."""
    x, y = ([int(p) if p.isdigit() else p.lower() for p in v.replace("-", ".").split(".")] for v in (a, b))
    for i in range(max(len(x), len(y))):
        p, q = x[i] if i < len(x) else 0, y[i] if i < len(y) else 0
        if p != q:
            return (1 if p > q else -1) if isinstance(p, int) and isinstance(q, int) else (1 if str(p) > str(q) else -1)
    return 0
