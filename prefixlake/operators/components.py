"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two grouped minima (combined map-side) joined back on the node. Nodes with very many
edges are spread over salts for that join, so no task holds one node's edges; lineage is cut once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.session import checkpointed

PIECE = 1024  # rows of one key that go to one task at least
HOT_KEYS = 20_000  # keys above a piece that can exist at all: what is broadcast has no more rows


def spread_join(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts`` on ``key``, with the rows of frequent keys spread over salts.

    A row's salt is a hash of the row, so a task that runs again deals its rows alike. ``facts`` has one row per key and ``count``, how many of the ``total`` rows hold it; ``count`` is
    dropped. Keys above ``total / HOT_KEYS`` rows are fewer than ``HOT_KEYS``, so their list is broadcast.
    """
    piece = max(PIECE, -(-total // HOT_KEYS))
    hot = facts.where(F.col(count) > piece).select(F.col(key).alias("_hot"), F.ceil(F.col(count) / piece).alias("_salts"))
    names = [c for c in facts.columns if c not in (key, count)]
    salted = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").drop("_hot")
    salted = salted.withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(F.lit(97), *rows.columns), F.col("_salts"))).otherwise(0).cast("long")).drop("_salts")
    every = F.sequence(F.lit(0).cast("long"), F.when(F.col(count) > piece, F.ceil(F.col(count) / piece) - 1).otherwise(0).cast("long"))
    held = facts.select(F.col(key).alias("_key"), *names, F.explode(every).alias("_at"))
    return salted.join(held, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_at")), how).drop("_key", "_salt", "_at")


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Hang the neighbours of every node on the least of them; ``edges`` has a > b."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = spread_join(both, least, "u", "n", 2 * total)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b); the component is its least node."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while True:
        total = edges.count()
        edges = checkpointed(_star(_star(edges, large=True, total=total), large=False, total=total))
        # Done when the edges are stars: every node hangs on one node, which hangs on none.
        twice = edges.groupBy("a").count().where("count > 1").select("a")
        chained = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if twice.union(chained).isEmpty():
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
