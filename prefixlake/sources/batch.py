"""A folder of feeds as one DataFrame, with what went wrong as rows.

All files of a kind are one scan, and a file's own headings are joined to its lines, so the plan does not
grow with the number of files. Nothing is decided while planning: a file that turns out broken while it
is read gives an error row, and the others are read.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.session import on_workers
from prefixlake.sources.lists import _cells, _sniffed
from prefixlake.sources.readers import ARRAY_KEYS, FIELD_NAMES, NESTED, RECORD, split_aliases
from prefixlake.sources.sqlite import best_table, quoted, text_batches

DELIMITED, LINES, DOCUMENTS, DATABASES = (".csv", ".tsv", ".txt"), (".jsonl", ".ndjson"), (".json",), (".db", ".sqlite")
ENTRIES = "array<struct<k:string,v:string>>"


def _scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> object:
    """A reader of the files with these endings, however they are written, at any depth; unreadable ones are passed over."""
    either = ",".join("*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{either}}}").option("ignoreCorruptFiles", "true")


def feed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind) of every supported file below a folder (S5, S8); contents are not read."""
    kinds = {"delimited": DELIMITED, "lines": LINES, "document": DOCUMENTS, "database": DATABASES}
    found = _scan(spark, folder, sum(kinds.values(), ())).format("binaryFile").load(folder).select("path")
    kind = F.coalesce(*[F.when(F.lower("path").rlike("|".join(s.replace(".", r"\.") + "$" for s in suffixes)), k) for k, suffixes in kinds.items()])
    return found.select("path", kind.alias("kind"))


def _name(c: Column) -> Column:
    """A heading as it is compared: trimmed, small, with underscores."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "^﻿", ""))), "[ -]", "_")


def record_fields(entries: Column) -> list[Column]:
    """The record's fields from (heading, value) pairs: the first prefix, of other fields the last that is not empty,
    else where nested records keep it (S10)."""

    def named(*names: str) -> Column:
        return F.filter(entries, lambda e: e["k"].isin(*names))

    out = []
    for field in RECORD:
        own = F.filter(named(*FIELD_NAMES[field]), lambda e: (F.coalesce(e["v"], F.lit("")) != "") & ~e["v"].startswith("{"))
        values = [F.try_element_at(own, F.lit(1 if field == "bin" else -1))["v"]]
        top, _, inner = NESTED.get(field, "").partition(".")
        if inner:
            holder = F.try_element_at(named(top), F.lit(1))["v"]
            values.append(F.nullif(F.get_json_object(holder, f"$.{inner}"), F.lit("")))
        value = F.coalesce(*values)
        if field == "aliases":
            value = F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<string>"), split_aliases(F.when(~value.startswith("["), value)))
        out.append(value.alias(field))
    return out


def _object(text: Column) -> Column:
    """(name, value) pairs of an object; null if the text is none."""
    pairs = F.transform(F.map_entries(F.from_json(F.when(text.rlike(r"^\s*\{"), text), "map<string,string>")), lambda e: F.struct(_name(e["key"]).alias("k"), e["value"].alias("v")))
    return pairs.cast(ENTRIES)


def _delimited(spark: SparkSession, folder: str) -> DataFrame:
    read = _scan(spark, folder, DELIMITED).text(folder, lineSep="\n")
    lines = read.select(F.regexp_replace("value", r"\r$", "").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = lines.where(F.trim("text") != "")
    # Each file's headings: its first line, found by one small row a file.
    heads = lines.groupBy("path").agg(F.min_by(F.struct("text", "block", "id"), F.struct("block", "id")).alias("h"))
    heads = heads.select("path", F.col("h.block").alias("_b"), F.col("h.id").alias("_i"), _sniffed(F.col("h.text")).alias("d"), F.transform(_cells(F.col("h.text"), _sniffed(F.col("h.text"))), _name).alias("names"))
    heads = heads.withColumn("fits", F.arrays_overlap("names", F.array(*[F.lit(n) for n in FIELD_NAMES["bin"]])))
    rows = lines.join(heads, "path").where((F.col("block") != F.col("_b")) | (F.col("id") != F.col("_i")))
    pairs = F.transform(F.arrays_zip(F.col("names").alias("k"), _cells(F.col("text"), F.col("d")).alias("v")), lambda z: F.struct(z["k"].alias("k"), z["v"].alias("v")))
    good = rows.where("fits").select("path", F.filter(pairs, lambda e: e["k"].isNotNull()).cast(ENTRIES).alias("entries"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(heads.where("not fits").select("path", F.lit(None).cast(ENTRIES).alias("entries"), F.lit("no heading names a prefix").alias("error")))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    text = _scan(spark, folder, LINES).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.trim("text") != "")
    return text.select("path", _object(F.col("text")).alias("entries")).withColumn("error", F.when(F.col("entries").isNull(), "a line is no object"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    text = _scan(spark, folder, DOCUMENTS).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("text"))
    listed = lambda c: F.transform(F.from_json(c, "array<map<string,string>>"), lambda m: F.transform(F.map_entries(m), lambda e: F.struct(_name(e["key"]).alias("k"), e["value"].alias("v"))))
    whole = F.from_json(F.when(F.col("text").startswith("{"), F.col("text")), "map<string,string>")
    held = F.coalesce(*[F.when(F.try_element_at("m", F.lit(k)).rlike(r"^\s*\["), F.try_element_at("m", F.lit(k))) for k in ARRAY_KEYS])
    text = text.withColumn("m", F.when(F.try_parse_json("text").isNotNull(), whole)).withColumn("held", held)
    keyed = F.forall(F.map_values("m"), lambda v: F.coalesce(v, F.lit("")).rlike(r"^\s*\{")) & (F.size("m") > 0)
    by_key = F.transform(F.map_entries("m"), lambda e: F.concat(F.array(F.struct(F.lit("bin").alias("k"), e["key"].alias("v"))).cast(ENTRIES), _object(e["value"])))
    alone = F.array(F.transform(F.map_entries("m"), lambda e: F.struct(_name(e["key"]).alias("k"), e["value"].alias("v"))))
    records = F.when(F.col("text").startswith("["), F.when(F.try_parse_json("text").isNotNull(), listed(F.col("text")))).when(F.col("held").isNotNull(), listed(F.col("held"))).when(keyed, by_key).otherwise(F.when(F.exists(alone[0], lambda e: e["k"].isin(*FIELD_NAMES["bin"])), alone))
    some = text.select("path", F.explode_outer(records.cast(f"array<{ENTRIES}>")).alias("entries"))
    return some.withColumn("error", F.when(F.col("entries").isNull(), "no document of records"))


def _databases(spark: SparkSession, folder: str) -> DataFrame:
    """Databases come whole, one file to a task; a large one is better read by the ``prefixlake_sqlite`` source."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(path: str, entries: list, error: str | None) -> pa.RecordBatch:
            n = len(entries)
            return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(entries, pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))), pa.array([error] * n, pa.string())], names=["path", "entries", "error"])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with sqlite3.connect(":memory:") as db:
                        db.deserialize(content.as_py())
                        table, columns = best_table(db)
                        names = [c.strip().lower().replace(" ", "_").replace("-", "_") for c in columns]
                        for part in text_batches(db.execute(f"select {', '.join(map(quoted, columns))} from {quoted(table)}"), columns):
                            yield out(path, [[{"k": k, "v": v} for k, v in zip(names, row, strict=True)] for row in zip(*(c.to_pylist() for c in part.columns), strict=True)], None)
                except (sqlite3.Error, ValueError) as error:
                    yield out(path, [None], str(error))

    files = _scan(spark, folder, DATABASES).format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(unpack, f"path string, entries {ENTRIES}, error string")


def read_batch(spark: SparkSession, folder: str) -> DataFrame:
    """(fields of a record, source_file, error) of everything below a folder.

    A row has either a prefix or an error: a line or document that holds no record, a file without a
    heading for prefixes, a file that can't be read. Rows without a prefix are left out; a file of no
    bytes is passed over by Spark's scans and has no row.
    """
    on_workers(spark)
    found = _delimited(spark, folder).unionByName(_lines(spark, folder)).unionByName(_documents(spark, folder)).unionByName(_databases(spark, folder))
    rows = found.select(*record_fields(F.col("entries")), "path", "error").where("bin is not null or error is not null")
    silent = feed_files(spark, folder).select("path").join(found.select(F.col("path").alias("_p")).distinct(), F.url_decode("path") == F.url_decode("_p"), "left_anti")
    silent = silent.select(*[F.lit(None).cast(t).alias(n) for n, t in rows.dtypes if n not in ("path", "error")], "path", F.lit("nothing could be read").alias("error"))
    return rows.unionByName(silent).withColumn("source_file", F.url_decode(F.element_at(F.split("path", "/"), -1))).drop("path")


def batch_report(rows: DataFrame) -> DataFrame:
    """(source_file, records, errors, first_error) of each file of a batch."""
    return rows.groupBy("source_file").agg(F.count("bin").alias("records"), F.count("error").alias("errors"), F.min("error").alias("first_error"))
