"""Readers, lists, exports and releases, over small files."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from prefixlake.sources import lists, readers, sinks
from prefixlake.sources.release import Releases, backfill


def put(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body)
    return f"file://{path}"


def test_csv_and_mapping(spark, tmp_path):
    path = put(tmp_path, "a.csv", "IIN;Bank Name;Country;aliases\n041472;Alpha, Inc;US;x|y\n510001;;GB;\n")
    got = readers.map_record(readers.read_csv(spark, path)).orderBy("bin").collect()
    assert [(r["bin"], r["issuer"], r["country"], r["aliases"]) for r in got] == [("041472", "Alpha, Inc", "US", ["x", "y"]), ("510001", None, "GB", None)]


def test_the_delimiter_is_sniffed_from_more_than_the_header(spark, tmp_path):
    path = put(tmp_path, "b.csv", 'bin|note, with, commas, and, more\n414720|a\n414721|b\n414722|c\n414723|d\n')
    assert readers.read_csv(spark, path).columns[0] == "bin"


def test_json_shapes(spark, tmp_path):
    nested = put(tmp_path, "n.json", '{"data": [{"bin": "414720", "scheme": "visa", "bank": {"name": "A"}, "country": {"alpha2": "US"}}]}')
    r = readers.map_record(readers.read_json(spark, nested)).first()
    assert (r["bin"], r["network"], r["issuer"], r["country"]) == ("414720", "visa", "A", "US")
    keyed = put(tmp_path, "k.json", '{"414720": {"bank": "A"}, "510001": {"bank": "B"}}')
    assert sorted((r["bin"], r["issuer"]) for r in readers.map_record(readers.read_json(spark, keyed)).collect()) == [("414720", "A"), ("510001", "B")]
    lines = put(tmp_path, "l.jsonl", '{"bin": "414720"}\nnot json\n{"bin": "510001", "bank": "B"}\n')
    assert sorted(r["bin"] for r in readers.map_record(readers.read_jsonl(spark, lines)).collect()) == ["414720", "510001"]


def test_sqlite_and_formats(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.sqlite") as db:
        db.execute("create table other (a text)")
        db.execute("create table things (bin text, bank text)")
        db.execute("insert into things values ('041472', 'A'), ('510001', null)")
    assert sorted((r["bin"], r["issuer"]) for r in readers.map_record(readers.read_sqlite(spark, str(tmp_path / "x.sqlite"))).collect()) == [("041472", "A"), ("510001", None)]
    with pytest.raises(ValueError, match="no reader"):
        readers.reader_for("x.bin")


def test_reading_differences(spark):
    a = spark.createDataFrame([("414720", "Visa", "US", "")], "bin string, network string, country string, city string")
    b = spark.createDataFrame([("414720", "visa ", "GB", "Rome")], "bin string, network string, country string, city string")
    assert [tuple(r) for r in readers.reading_differences(a, b, ["network", "country", "city"]).collect()] == [("414720", "country", "US", "GB")]


LIST = """# a list
# list: Pays = accepted_in
# list: confidence = 0.5
bin,bank,Pays,level
414720,"Alpha, Inc",FR,PREPAID GOLD
41472,Short,FR,
510001,Beta,DE,Gold
414720,alpha  inc,FR,
414720,"ALPHA, INC",IT,Gold
IIN,issuer,country,phone
60110000,Gamma,US,5.5E+11
x,Nobody,US,
"""


def test_lists(spark, tmp_path):
    records = lists.list_records(lists.read_lists(spark, put(tmp_path, "list.csv", LIST))).cache()
    got = {r["line"]: r for r in records.collect()}
    assert (got[5]["issuer"], got[5]["prepaid"], got[5]["country"], got[5]["confidence"]) == ("Alpha, Inc", "true", None, 0.5)
    assert got[6]["error"] == "too short" and got[12]["error"] == "not digits"
    assert (got[11]["bin"], got[11]["issuer"], got[11]["country"], got[11]["damaged"]) == ("60110000", "Gamma", "US", 1)
    assert got[5]["original"] == {"bin": "414720", "bank": "Alpha, Inc", "Pays": "FR", "level": "PREPAID GOLD"}
    facts = lists.list_facts(records).orderBy("line").collect()
    assert [(f["bin"], f["issuer"], f["line"], f["copies"]) for f in facts] == [("414720", "ALPHA, INC", 5, 2), ("510001", "Beta", 7, 1), ("414720", "alpha  inc", 8, 1), ("60110000", "Gamma", 11, 1)]
    r = lists.list_report(records).first()
    assert (r["read"], r["rejected"], r["accepted"], r["prefixes"], r["short"], r["damaged"], r["duplicates"]) == (5, 2, 4, 3, 1, 1, 1)
    assert [x["line"] for x in lists.origin(records, "414720").collect()] == [5, 8, 9]


def test_split_fused(spark):
    rows = spark.createDataFrame([("GOLD ALPHA BANK",), ("CLASSIC ALPHA BANK",), ("CLASSIC BETA BANK",), ("WHAT",)], "text string")
    one = spark.createDataFrame([("GOLD",)], "level string")
    none = spark.createDataFrame([], "bank string")
    got = {r["text"]: (r["level"], r["bank"]) for r in lists.split_fused(rows, one, none).collect()}
    assert got == {"GOLD ALPHA BANK": ("GOLD", "ALPHA BANK"), "CLASSIC ALPHA BANK": ("CLASSIC", "ALPHA BANK"), "CLASSIC BETA BANK": ("CLASSIC", "BETA BANK"), "WHAT": (None, None)}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("510001", "=evil()", True), ("414720", None, False)], "bin string, institution string, is_current boolean")
    assert [tuple(r) for r in sinks.export_frame(rows).collect()] == [("414720", "", "false"), ("510001", "'=evil()", "true")]
    for kind in ("csv", "json", "txt"):
        sinks.write_export(rows, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 2
    sinks.write_prefixes(rows, f"file://{tmp_path}/prefixes")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/prefixes").collect()] == ["414720", "510001"]
    report = sinks.report_sections("demo", [("rows", rows)])
    assert "rows: bin = 414720" in sinks.render_report(report, "txt") and sinks.render_report(report, "json").startswith("[")
    with pytest.raises(ValueError, match="pdf"):
        sinks.render_report(report, "pdf")


def test_releases(spark, tmp_path):
    held = Releases(spark, f"file://{tmp_path}/releases")
    assert held.live() is None and held.info().count() == 0
    bins = spark.range(10).select(F.col("id"), (F.col("id") + 414720).cast("string").alias("bin"))
    held.write("1", {"bins": bins})
    held.publish("1", "2024-01-01")
    held.write("2", {"bins": bins.union(bins)})
    held.publish("2", "2024-01-02")
    assert held.live() == "2" and held.table("bins").count() == 20 and held.verify("1")
    with pytest.raises(ValueError, match="not published"):
        held.write("3", {"bins": bins.limit(2)})
    assert held.rollback("2024-01-03") == "1" and held.live() == "1"
    held.backup(f"file://{tmp_path}/backup")
    held.restore(f"file://{tmp_path}/backup", "1", "2024-01-04")
    assert [r["version"] for r in held.lineage().collect()] == ["1", "1", "2", "1"] and held.info().first()["healthy"]
    assert "span_low" in backfill(bins, 1).columns
