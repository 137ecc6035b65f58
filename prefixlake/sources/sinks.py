"""Exports: tables, single records, prefix lists and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.text import csv_safe

# Export columns and their headings, and the caps of each export.
EXPORT_COLUMNS = {
    "bin": "BIN", "prefix_length": "Length", "network": "Network", "card_type": "Card type", "funding_type": "Funding", "institution": "Issuer", "country": "Country", "country_code": "Country code",
    "region": "Region", "city": "City", "status": "Status", "is_current": "Current", "is_prepaid": "Prepaid", "is_commercial": "Commercial", "relationship_type": "Relationship",
}
EXPORT_CAP, PORTFOLIO_CAP, REPORT_CAP = 250_000, 100_000, 10_000
REPORT_TYPES = ("bin", "institution", "portfolio", "country", "analytics", "quality")
UNAVAILABLE = ("pdf", "xlsx")


def export_frame(rows: DataFrame, cap: int | None = EXPORT_CAP) -> DataFrame:
    """Headed, text-only export rows in prefix order; every cell is safe to open in a spreadsheet."""
    present = [c for c in EXPORT_COLUMNS if c in rows.columns]
    out = rows.orderBy("bin").select(*[csv_safe(F.col(c).cast("string")).alias(EXPORT_COLUMNS[c]) for c in present])
    return out.limit(cap) if cap else out


def write_export(rows: DataFrame, path: str, kind: str = "csv", cap: int | None = EXPORT_CAP) -> None:
    """Write export rows as csv, json or txt (S12): one folder of part files, as Spark writes."""
    out = export_frame(rows, cap)
    if kind == "csv":
        out.write.csv(path, header=True, escape='"', quoteAll=False)
    elif kind == "json":
        out.write.json(path)
    elif kind == "txt":
        out.select(F.concat_ws("\t", *out.columns).alias("value")).write.text(path)
    else:
        raise ValueError(f"no export as {kind}")


def write_prefixes(rows: DataFrame, path: str) -> None:
    """One prefix a line, in order."""
    rows.select("bin").orderBy("bin").write.text(path)


def record_fields(record: DataFrame, key: str = "bin") -> DataFrame:
    """(key, position, field, value): records as field and value rows."""
    columns = [c for c in record.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(EXPORT_COLUMNS.get(c, c.replace("_", " ").capitalize())).alias("field"), csv_safe(F.col(c).cast("string")).alias("value")) for c in columns])
    return record.select(key, F.posexplode(pairs).alias("position", "p")).select(key, "position", "p.*")


def record_json(records: DataFrame) -> DataFrame:
    """One JSON text per record, with current and former issuers apart (S13); needs a ``relations`` array."""
    now = F.filter("relations", lambda r: r["is_current"])
    then = F.filter("relations", lambda r: ~r["is_current"])
    rest = [c for c in records.columns if c != "relations"]
    return records.select("bin", F.to_json(F.struct(*rest, now.alias("current_issuers"), then.alias("former_issuers"))).alias("json"))


def available_formats() -> dict[str, bool]:
    """Which report formats can be written here."""
    return {"csv": True, "json": True, "txt": True} | dict.fromkeys(UNAVAILABLE, False)


def report_sections(title: str, sections: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(section, position, field, value): a report's tables in one long frame, at most ``REPORT_CAP`` rows each."""
    out = None
    for n, (name, df) in enumerate(sections):
        capped = df.limit(REPORT_CAP)
        cells = F.array(*[F.struct(F.lit(c).alias("field"), csv_safe(F.col(c).cast("string")).alias("value")) for c in capped.columns])
        part = capped.select(F.lit(title).alias("report"), F.lit(n).alias("part"), F.lit(name).alias("section"), F.posexplode(cells).alias("position", "c")).select("report", "part", "section", "position", "c.*")
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def render_report(report: DataFrame, kind: str) -> str:
    """A small report as csv, json or text (S14). A report is capped, so it fits the driver."""
    if kind not in available_formats() or not available_formats()[kind]:
        raise ValueError(f"{kind} reports are not available here")
    rows = report.orderBy("part", "section", "position").collect()
    if kind == "json":
        return json.dumps([r.asDict() for r in rows], ensure_ascii=False)
    if kind == "csv":
        quoted = [[f'"{str(v).replace(chr(34), chr(34) * 2)}"' for v in (r["section"], r["field"], r["value"])] for r in rows]
        return "\n".join([",".join(q) for q in [["section", "field", "value"], *quoted]])
    return "\n".join(f"{r['section']}: {r['field']} = {r['value']}" for r in rows)
