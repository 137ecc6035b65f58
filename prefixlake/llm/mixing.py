"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The whole mix is cut into blocks of ``block`` words. Sources get blocks by highest quotients
(target / 1, / 3, / 5 ...), up to ``cap`` times what they hold; the blocks of a source go to its
shards by the same rule over shard sizes, so every shard has an integer quota. Inside a shard the
documents stand in a seeded order on one line of words: whole laps are repeats, and the rest of the
quota is one run of blocks that begins at a seeded block and wraps around the end, so that only the
documents at its ends are cut.

Only one row per source reaches the driver. Shards hold about ``SHARD_DOCS`` documents, so a source
with a third of all rows is many shards; the running sums are windows inside one shard. Shards get their
quotas through a tree of at most ``FANOUT`` children a node, so no task sees all shards of a source.

Defined results: a null text has size 0; sources without words have target 0; an empty table gives
an empty result; repeated rows are separate documents; null is a source of its own, ordered last; equal
quotients go to the earlier source or shard; other columns keep their names and values, whatever they are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.shared import packed, unpacked, written
from prefixlake.llm.textarrays import chunks, word_spans

SHARD_DOCS = 4096
BLOCK = 16
FANOUT = 4096


def words(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float, share: float = 1.0) -> list[float]:
    """Targets that add up to ``share`` of all sizes by weight, none above ``cap`` times its size.

    What a capped source can't take is shared again among the others by weight, until none is above.
    """
    left, out, free = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / weight > cap * sizes[i]}
        if not above:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in above]
    return out


def apportion(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Sainte-Lague: ``seats`` by highest quotients vote / (2 k + 1), none above ``most``; ties to the earlier."""
    total = sum(votes)
    if total <= 0:
        return [0] * len(votes)
    # Start from the divisor that fits exact proportions, a little short, and hand out the rest one by one.
    out = [min(m, max(0, int(v * seats / total - 0.5))) for v, m in zip(votes, most, strict=True)]
    queue = [(-v / (2 * n + 1), i) for i, (v, n, m) in enumerate(zip(votes, out, most, strict=True)) if n < m and v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(out)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * out[i] + 1), i))
    return out


def most_blocks(size: float, cap: float, block: int) -> int:
    """Blocks up to ``cap`` times a size; the last may be part of one."""
    return math.ceil(cap * size / block)


def shard_quotas(shards: DataFrame, cap: float, block: int) -> DataFrame:
    """``shards`` (source, shard, shard_size, blocks of the source) with the quota of each, from the source down a tree.

    The nodes of a level are the shards' numbers without their last digits to the base ``FANOUT``; each
    node deals what it got to its children by the same rule.
    """
    count = shards.agg(F.max("shard")).first()[0] or 0
    base, top = FANOUT, 1
    while count // top >= base:
        top *= base

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        most = [most_blocks(s, cap, block) for s in rows.node_size]
        return rows.assign(quota=apportion(rows.node_size.tolist(), int(rows.blocks.iloc[0]), most))[["source", "node", "quota"]]

    above = None
    while top:
        nodes = shards.groupBy("source", F.call_function("div", F.col("shard"), F.lit(top)).alias("node")).agg(F.sum("shard_size").alias("node_size"), F.max("blocks").alias("blocks"))
        nodes = nodes.withColumn("parent", F.call_function("div", F.col("node"), F.lit(base)))
        if above is not None:
            got = above.select(F.col("source").alias("_source"), F.col("node").alias("_node"), "quota")
            nodes = nodes.join(got, F.col("source").eqNullSafe(F.col("_source")) & (F.col("parent") == F.col("_node"))).withColumn("blocks", F.col("quota")).drop("_source", "_node", "quota")
        above = nodes.groupBy("source", "parent").applyInPandas(deal, "source string, node long, quota long")
        top //= base
    done = above.select(F.col("source").alias("_source"), "node", "quota")
    return shards.join(done, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("node"))).select("source", "shard", "shard_size", "quota")


def plan(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, share: float = 1.0, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, laps, from1, to1, from2, to2) for every document.

    ``taken`` = laps * size plus the words in [from1, to1) and [from2, to2) of the document. Weights
    go to the sources by code point, null last, and repeat.
    """
    spark = documents.sparkSession
    sized = written(documents.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")  # texts are read once
    stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in stats]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(stats))], cap, share)
    blocks = apportion(goal, round(share * sum(sizes) / block), [most_blocks(s, cap, block) for s in sizes])
    rows = [(r["source"], s, g, b, max(1, -(-r["docs"] // SHARD_DOCS))) for r, s, g, b in zip(stats, sizes, goal, blocks, strict=True)]
    sources = spark.createDataFrame(rows, "source string, source_size long, target double, blocks long, shards long")
    order = F.xxhash64(F.lit(seed), "doc_id")
    dealt = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("shard", F.pmod(order, F.col("shards")))

    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("blocks").alias("blocks"))
    shards = shard_quotas(shards, cap, block).select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        "shard_size",
        F.least(F.col("quota") * block, F.floor(F.col("shard_size") * cap)).alias("words"),
        (F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1))) * block).alias("begin"),
    )
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id", "size")
    placed = dealt.withColumn("at", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    placed = placed.withColumn("laps", F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0))
    placed = placed.withColumn("run", F.col("words") - F.col("laps") * F.col("shard_size"))
    end = F.col("begin") + F.col("run")

    def cut(low: Column, high: Column) -> tuple[Column, Column]:
        a = F.greatest(low - F.col("at"), F.lit(0))
        b = F.least(high - F.col("at"), F.col("size"))
        return F.when(b > a, a).otherwise(0), F.when(b > a, b).otherwise(0)

    from1, to1 = cut(F.col("begin"), F.least(end, F.col("shard_size")))
    from2, to2 = cut(F.lit(0), end - F.col("shard_size"))
    placed = placed.withColumns({"from1": from1, "to1": to1, "from2": from2, "to2": to2})
    taken = F.col("laps") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "laps", "from1", "to1", "from2", "to2")


def materialise(documents: DataFrame, mix: DataFrame) -> DataFrame:
    """The mix itself: whole documents once per lap, and documents at a run's ends cut to its words.

    ``documents`` needs a unique ``doc_id``; its other columns pass through, ``n_chars`` follows the text.
    """
    mix = mix.select("doc_id", "size", "laps", "from1", "to1", "from2", "to2").where("taken > 0" if "taken" in mix.columns else "true")
    full = F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")), F.col("laps").cast("int"))
    parts = F.array(F.struct(F.col("from1").alias("a"), F.col("to1").alias("b")), F.struct(F.col("from2").alias("a"), F.col("to2").alias("b")))
    runs = mix.select("doc_id", "size", F.explode(F.concat(full, F.filter(parts, lambda p: p["b"] > p["a"]))).alias("run")).select("doc_id", "size", "run.a", "run.b")
    joined = packed(documents).join(runs, F.col("row.doc_id").eqNullSafe(F.col("doc_id"))).select("row", "a", "b", "size")
    names = documents.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size = (batch.column(n).to_numpy() for n in ("a", "b", "size"))
            batch = unpacked(batch.column("row"), names)
            texts: list[bytes] = []
            for first, data, offsets in chunks(batch.column("text")):
                raw = data.tobytes()
                starts, ends, word = (None, None, None) if ((a == 0) & (b == size))[first : first + len(offsets) - 1].all() else word_spans(data, offsets)
                for i in range(len(offsets) - 1):
                    x, y = a[first + i], b[first + i]
                    if x == 0 and y == size[first + i]:
                        texts.append(raw[offsets[i] : offsets[i + 1]])
                    else:
                        texts.append(raw[starts[word[i] + x] : ends[word[i] + y - 1]])
            at = batch.schema.get_field_index("text")
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(cut, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def quota_error(mix: DataFrame) -> DataFrame:
    """Per source size and target: the words taken and their relative distance from the target."""
    out = mix.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"))
    return out.withColumn("error", F.abs(F.col("taken") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))
