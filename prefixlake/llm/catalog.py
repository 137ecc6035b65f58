"""The ``opN_<name>`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.llm import licences, linededup, lm, media, mixing, neardup, neighbours, packing, periods, quality, resampling, toxicity
from prefixlake.llm.shared import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt from labelled documents outside fold 1 of 3."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(documents, labels.where(quality.fold_of(F.col("doc_id"), 3) != 1))
    scored = quality.score_quality(documents, model)
    return scored.select("doc_id", (quality.fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learnt from documents outside fold 2 of 4."""
    documents = table(spark, sf_dir, "documents")
    model = quality.fit_language(documents.where(quality.fold_of(F.col("doc_id"), 4) != 2))
    scored = quality.score_language(documents, model)
    return scored.select("doc_id", (quality.fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens."""
    documents = table(spark, sf_dir, "documents")
    pieces = packing.tokenized(documents, public_tokenizers.path(packing.TOKENIZER))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces, documents.count())


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more hold."""
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, Jaccard 0.85 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@_query
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG audio stream in the shared folder, read back and described; a lost payload is an error."""
    stored = written(media.write_media(table(spark, sf_dir, "documents")), "media", compression="zstd")
    found = media.feature(media.read_media(stored))
    lost = F.raise_error(F.concat(F.lit("payload of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" is not whole")))
    found = found.withColumn("payload", F.when(F.col("complete"), F.col("payload")).otherwise(lost.cast("binary")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "duration",
        "frame_offsets",
    )


@_query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth vector, among all others."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@_query
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-log-likelihood of every document under a network trained on all of them."""
    documents = table(spark, sf_dir, "documents")
    return lm.score(documents, *lm.fit(documents))


@_query
def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence text found in every document: coverage and span."""
    return licences.scan(table(spark, sf_dir, "documents"))


@_query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the rank of the drawn twentieth."""
    return resampling.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, after loops are planted in one of ten."""
    documents = table(spark, sf_dir, "documents")
    found = periods.find_runs(documents.select("doc_id", periods.looped(F.col("doc_id"), F.col("text")).alias("text")))
    best = periods.strongest(F.col("runs"))
    line = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), line.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        "best.*",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt from labelled documents outside fold 1 of 3."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(quality.fold_of(F.col("doc_id"), 3) != 1))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", (quality.fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "passage_start", "passage_words")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op6_neardup"] = rf"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array({_FOLDED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) when len(w) > 0 then [array_to_string(w, chr(10))] else [] end) as g from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as id, doc_id as root from documents union select e.b, r.root from reach r join edges e on e.a = r.id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, m.root as component_id, d.doc_id = m.root as kept
from documents d left join sizes s on s.doc_id = d.doc_id join (select id, min(root) as root from reach group by id) m on m.id = d.doc_id"""

ORACLES["op8_line_dedup"] = """
with split as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from split),
frequent as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(f.k) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.k is null), '')) as kept_sha256
from keyed left join frequent f on f.k = keyed.k group by doc_id"""
