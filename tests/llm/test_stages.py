from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from prefixlake.llm.shared import written
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, SF), name)
        if name != "pack":
            assert after.columns == names and after.where(F.col("n_chars") != F.length("text")).count() == 0
        if name == "language":
            assert after.count() >= 0.95 * before.count()
        if name == "line_dedup":
            assert after.count() == before.count()
        if name == "near_dedup":
            assert 0 < after.count() <= before.count() and after.select("doc_id").distinct().count() == after.count()
        before = after
    fills = before.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fills.where("n > 4096 or n <> end").count() == 0


def test_odd_and_empty_documents(spark, documents):
    for texts in (ODD, []):
        docs = documents(texts)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "odd")
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_take_any_names_and_texts(spark, documents):
    """Each stage alone, over odd texts, a null id and columns called like its own."""
    names = ["_id", "_a", "_b", "_size", "n_lines", "n_dropped", "sequence_id", "offset", "hits", "row", "_letters", "kept", "component_id", "shard", "label"]
    docs = documents(ODD).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    kept = {"line_dedup": len(ODD), "near_dedup": len(ODD) - 2}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns and all([r[c] for c in names] == list(range(len(names))) for r in rows), name
        assert len(rows) == kept.get(name, len(rows)), name
    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    assert len({r["doc_id"] for r in pieces}) == len(ODD) and all(r["length"] >= 1 for r in pieces)
