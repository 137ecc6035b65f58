"""A folder of good and broken feeds, and databases read in splits."""

from __future__ import annotations

import gzip
import sqlite3

import pytest
from pyspark.sql import functions as F

from prefixlake.sources import batch, readers
from prefixlake.sources.sqlite import NAME, register


@pytest.fixture
def folder(tmp_path):
    deep = tmp_path / "in/deep"
    deep.mkdir(parents=True)
    top = tmp_path / "in"
    (top / "a.csv").write_text('IIN;Bank Name;Country;aliases;bank\n041472;"Alpha; Inc";US;x|y;\n\n510001;;GB;;Last\n')
    (deep / "b.TSV").write_text("bank\tprefix\r\nBeta\t414721\r\n")
    (top / "no heading.txt").write_text("what\nis this\n")
    (top / "empty.csv").write_text("")
    (top / "c.jsonl").write_text('{"bin": "510002", "bank": {"name": "C"}, "scheme": "visa"}\nnot json\n[1]\n{"bin": "510003", "aliases": ["p", "q"]}\n')
    (top / "d.json").write_text('{"data": [{"bin": "510004", "country": {"alpha2": "FR"}}, {"bin": ""}]}')
    (top / "e.json").write_text('{"510005": {"bank": "E"}, "510006": {}}')
    (top / "f.json").write_text('[{"bin": "510007"}]')
    (top / "g.json").write_text('{"bin": "510008", "Bank": "G"}')
    (top / "h.json").write_text('[{"bin": "510009"')
    (top / "i.csv.gz").write_bytes(gzip.compress(b"bin\n999999\n")[:-12])
    (top / "notes.md").write_text("bin\n1\n")
    (top / "j.db").write_text("not a database")
    with sqlite3.connect(deep / "k.sqlite") as db:
        db.execute('create table t ("Bin" text, bank text)')
        db.executemany("insert into t values (?, ?)", [("510010", "K"), (510011, None), (None, "x")])
    return f"file://{top}"


def test_errors_are_rows(spark, folder):
    rows = batch.read_batch(spark, folder).collect()
    good = {r["bin"]: (r["issuer"], r["source_file"]) for r in rows if r["bin"]}
    assert good == {
        "041472": ("Alpha; Inc", "a.csv"), "510001": ("Last", "a.csv"), "414721": ("Beta", "b.TSV"), "510002": ("C", "c.jsonl"), "510003": (None, "c.jsonl"), "510004": (None, "d.json"),
        "510005": ("E", "e.json"), "510006": (None, "e.json"), "510007": (None, "f.json"), "510008": ("G", "g.json"), "510010": ("K", "k.sqlite"), "510011": (None, "k.sqlite"),
    }
    wrong = sorted((r["source_file"], r["error"]) for r in rows if r["error"])
    assert wrong == [
        ("c.jsonl", "a line is no object"), ("c.jsonl", "a line is no object"), ("h.json", "no document of records"),
        ("j.db", "file is not a database"), ("no heading.txt", "no heading names a prefix"),
    ]
    by = {r["bin"]: r for r in rows}
    assert by["041472"]["aliases"] == ["x", "y"] and by["510003"]["aliases"] == ["p", "q"] and by["510004"]["country"] == "FR" and by["510002"]["network"] == "visa"
    report = {r["source_file"]: (r["records"], r["errors"], r["first_error"]) for r in batch.batch_report(batch.read_batch(spark, folder)).collect()}
    assert report["c.jsonl"] == (2, 2, "a line is no object") and report["a.csv"] == (2, 0, None) and len(report) == 11


def test_an_unreadable_file_does_not_stop_the_batch(spark, tmp_path):
    (tmp_path / "good.csv").write_text("bin\n414720\n")
    (tmp_path / "bad.csv").write_bytes(b"\x1f\x8b\x00broken")
    (tmp_path / "worse.sqlite").write_bytes(b"SQLite format 3\x00" + b"\xff" * 5000)
    rows = batch.read_batch(spark, f"file://{tmp_path}").collect()
    assert [r["bin"] for r in rows if r["bin"]] == ["414720"] and {r["source_file"] for r in rows if r["error"]} == {"bad.csv", "worse.sqlite"}


def test_folder_without_feeds(spark, tmp_path):
    (tmp_path / "x.md").write_text("")
    assert batch.read_batch(spark, f"file://{tmp_path}").count() == 0


def test_databases_are_read_in_splits(spark, tmp_path):
    path = str(tmp_path / "big one.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table other (a text)")
        db.execute('create table things (bin text, "the ""bank""" text, n integer)')
        db.executemany("insert into things(rowid, bin, \"the \"\"bank\"\"\", n) values (?, ?, ?, ?)", ((i * 7 - 500, f"{400000 + i}", None if i % 3 else "B", i) for i in range(30_000)))
        db.execute("create table keyed (code text primary key, n int) without rowid")
        db.execute("insert into keyed values ('1', 2)")
        db.execute("create table none (code text)")
    df = register(spark).read.format(NAME).option("split_mb", "0.1").load(path)
    assert df.columns == ["bin", 'the "bank"', "n"] and df.rdd.getNumPartitions() > 5
    assert df.agg(F.count("bin"), F.count('the "bank"'), F.sum(F.col("n").cast("long")), F.countDistinct("bin")).first()[:] == (30_000, 10_000, sum(range(30_000)), 30_000)
    assert df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 10_000
    assert [tuple(r) for r in spark.read.format(NAME).option("table", "keyed").load(path).collect()] == [("1", "2")]
    assert spark.read.format(NAME).option("table", "none").load(f"file://{path}").count() == 0
    assert readers.read_sqlite(spark, path).count() == 30_000
