"""Consecutive numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.session import checkpointed


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1, as column ``name``.

    Rows are sorted by ranges; a row's place is its place in its part, and the rows of the parts before
    it. Only the parts' sizes, one row a part, are summed in one task. ``order`` should be total.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    own = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + own).alias(name))
