"""A training-corpus pipeline over ``documents``: five stages, each one operator of ``prefixlake.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.llm import linededup, mixing, neardup, packing, quality
from prefixlake.llm.shared import quoted, table, written
from prefixlake.session import on_workers


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that identification rejects go.

    Null, empty and letterless texts are rejected; repeated rows share their fate; an empty table, or one
    without any ``lang``, keeps nothing; other columns pass through.
    """
    on_workers(spark)
    return quality.accepted_language(docs, quality.fit_language(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; ``n_chars`` follows the text.

    Every document stays, a null or emptied text as the empty one; repeated rows count as documents of
    their own; other columns pass through, whatever their names.
    """
    on_workers(spark)
    kept = linededup.drop_repeated_lines(docs).select(*[F.col(quoted(c)) for c in docs.columns])
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the least id: five-word shingles, Jaccard 0.8 or more.

    Texts without words are alike to nothing and stay; rows that share an id stay or go together; other
    columns pass through.
    """
    on_workers(spark)
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; repeats are rows of their own.

    Texts without words have nothing to give and go; a null source is a source; documents at a run's ends
    are cut to the words taken; other columns pass through, whatever their names.
    """
    on_workers(spark)
    return mixing.materialise(docs, mixing.plan(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of at most 4096 tokens: where each piece of each document stands.

    A null text is packed as the empty one, which is its end mark; repeats are pieces of their own; an
    empty table gives no sequence; only doc_id and text are read.
    """
    on_workers(spark)
    pieces = packing.tokenized(docs, public_tokenizers.path(packing.TOKENIZER))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, docs.count())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
