"""Containment joins as equi-joins, and bounded graph expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.session import checkpointed


def prefix_join(queries: DataFrame, prefixes: DataFrame, q: str = "q", bin: str = "bin") -> DataFrame:
    """Every prefix that contains a query: no longer than it, and equal to its head over eight digits.

    A query becomes one row per head length, four to eight, so containment is an equality on the
    first eight digits; only lengths above eight need the residual test.
    """
    heads = F.explode(F.transform(F.sequence(F.lit(4), F.least(F.greatest(F.length(q), F.lit(4)), F.lit(8))), lambda n: F.substring(F.col(q), F.lit(1), n)))
    asked = queries.withColumn("_head", heads)
    held = prefixes.withColumn("_key", F.substring(bin, 1, 8))
    return asked.join(held, (asked["_head"] == held["_key"]) & (F.length(held[bin]) <= F.length(asked[q]))).drop("_head", "_key")


def children_join(queries: DataFrame, prefixes: DataFrame, q: str = "q", bin: str = "bin") -> DataFrame:
    """Every longer prefix below a query of at most seven digits."""
    asked = queries.where(F.length(q) < 8).withColumn("_size", F.length(q))
    sizes = F.explode(F.sequence(F.lit(4), F.least(F.length(bin) - 1, F.lit(7))))
    held = prefixes.where(F.length(bin) > 4).withColumn("_n", sizes).withColumn("_key", F.expr(f"substr({bin}, 1, _n)"))
    return asked.join(held, (asked[q] == held["_key"]) & (asked["_size"] == held["_n"])).drop("_size", "_key", "_n")


def range_join(values: DataFrame, ranges: DataFrame, value: Column, low: str, high: str) -> DataFrame:
    """Every range that contains a value, both ends included.

    A range is kept at the power of ten just above its width, where it touches at most two buckets;
    a value asks one bucket per power. Wide and narrow ranges cost the same, and no side is broadcast
    unless the planner finds it small.
    """
    held = ranges.withColumn("_level", F.length((F.col(high) - F.col(low)).cast("string")))
    held = held.withColumn("_size", F.pow(F.lit(10), F.col("_level")).cast("long"))
    held = held.withColumn("_bucket", F.explode(F.sequence(F.expr(f"{low} div _size"), F.expr(f"{high} div _size"))))
    asked = values.withColumn("_value", value.cast("long")).withColumn("_at", F.explode(F.sequence(F.lit(1), F.lit(9))))
    asked = asked.withColumn("_in", F.expr("_value div cast(pow(10, _at) as bigint)"))
    on = (asked["_at"] == held["_level"]) & (asked["_in"] == held["_bucket"]) & F.col("_value").between(F.col(low), F.col(high))
    return asked.join(held, on).drop("_level", "_size", "_bucket", "_value", "_at", "_in")


def expand_graph(roots: DataFrame, edges: DataFrame, depth: int | None = 4) -> DataFrame:
    """(root, id, level): what each root reaches over (parent, child) edges in at most ``depth`` steps.

    Semi-naive: a level joins only what the level before found, and keeps only nodes its root has not
    met, so cycles end. Every frontier is checkpointed, so a level's plan is one join and one anti-join
    whatever the depth; ``None`` goes on until nothing new is found.
    """
    edges = checkpointed(edges.select("parent", "child").distinct())
    frontier = checkpointed(roots.select("root", F.col("root").alias("id")).distinct())
    found, levels = frontier, [frontier.withColumn("level", F.lit(0))]
    while (depth is None or len(levels) <= depth) and not frontier.isEmpty():
        step = frontier.join(edges, frontier["id"] == edges["parent"]).select("root", F.col("child").alias("id")).distinct()
        frontier = checkpointed(step.join(found, ["root", "id"], "left_anti"))
        levels.append(frontier.withColumn("level", F.lit(len(levels))))
        found = found.unionByName(frontier)
    return reduce(DataFrame.unionByName, levels)
