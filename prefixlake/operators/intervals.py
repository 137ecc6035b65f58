"""Elementary intervals: the number line cut once at every end of every range.

Between two neighbouring cuts the ranges that hold are the same, so whatever is to be known of them is
known once per interval, and a value asks one interval instead of every range that contains it.

No task sweeps the whole line. Equal ranges are summed first; then a range is moved as at most two pieces, what it
holds of the cells of ``CELL`` numbers at its ends, and the whole cells between as decimal blocks of cells. A
piece is laid out as whole decimal blocks only where its cell is (at most eighteen a power of ten), what is to be
known is summed per block, and an interval gathers the blocks above its first value, one a power of ten; none of
these rows is moved. Values find their interval in buckets of ``BUCKET`` numbers; both sides are distinct numbers
there, so a bucket holds no more than twice that, however hot it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 8
BUCKET = 10_000
CELL_DIGITS = 3
CELL = 10**CELL_DIGITS
_LEVEL = 10**9


def _run(start: Column, stop: Column, level: int) -> Column:
    """Keys of the blocks from ``start`` up to before ``stop`` at one power of ten."""
    return F.when(start < stop, F.sequence(start + level * _LEVEL, stop - 1 + level * _LEVEL)).otherwise(F.array().cast("array<bigint>"))


def _div(a: Column, k: int) -> Column:
    """Whole tens to the power ``k`` in ``a``."""
    return F.call_function("div", a, F.lit(10**k).cast("long"))


def blocks(low: Column, high: Column, top: int = DIGITS) -> Column:
    """Keys of the largest whole decimal blocks, of up to ``top`` digits, that make up ``low`` to ``high``, both included."""
    low, stop = low.cast("long"), high.cast("long") + 1
    first = [_div(low + (10**k - 1), k) for k in range(top + 1)]
    last = [_div(stop, k) for k in range(top + 1)]
    parts = [_run(first[top], last[top], top)]
    for k in range(top):
        whole = first[k + 1] < last[k + 1]
        parts.append(_run(first[k], F.when(whole, first[k + 1] * 10).otherwise(last[k]), k))
        parts.append(F.when(whole, _run(last[k + 1] * 10, last[k], k)).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*parts)


def above(value: Column, top: int = DIGITS) -> Column:
    """Keys of the blocks of up to ``top`` digits that contain a value, one a power of ten."""
    return F.array(*[_div(value.cast("long"), k) + k * _LEVEL for k in range(top + 1)])


def _held(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """The ranges that a number of ``DIGITS`` digits can lie in."""
    return ranges.where((F.col(low) <= F.col(high)) & (F.col(low) < 10**DIGITS))


def starts(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """(start) of each elementary interval."""
    edges = _held(ranges, low, high).select(F.explode(F.array(F.col(low).cast("long"), F.col(high).cast("long") + 1)).alias("start"))
    every = ranges.sparkSession.range(0, 10**DIGITS, BUCKET).withColumnRenamed("id", "start")
    return edges.union(every).where(F.col("start") < 10**DIGITS).distinct()


def _ends(low: Column, high: Column) -> Column:
    """The pieces (cell, low, high) of a range in the cells of its two ends, or in its only one."""
    first, last = _div(low, CELL_DIGITS), _div(high, CELL_DIGITS)

    def piece(cell: Column, a: Column, b: Column) -> Column:
        return F.struct(cell.alias("cell"), a.alias("_low"), b.alias("_high"))

    return F.when(first == last, F.array(piece(first, low, high))).otherwise(F.array(piece(first, low, first * CELL + (CELL - 1)), piece(last, last * CELL, high)))


def cut(ranges: DataFrame, low: str, high: str, keys: list[str], per_block: dict[str, Column], per_interval: dict[str, Column], asked: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(cell, start, *keys, *per_interval): for each elementary interval, the ranges that hold there, grouped by ``keys``.

    ``asked`` (start, ...), of distinct rows, asks at its own numbers instead; its other columns come after ``start``. ``parts``
    is the number of tasks, if Spark is not to choose it.

    ``per_block`` aggregates ranges, ``per_interval`` its results, in the same order, so both must be such that
    parts can be put together in any number of steps (sums, least and greatest). Intervals where nothing holds are rows of nulls; an interval ends where the next begins, and begins anew at every bucket. Rows
    are dealt by ``cell``, so what groups them by ``cell`` and ``start`` moves no more.
    """
    names = [*keys, *per_block]
    again = [c.alias(n) for n, c in zip(per_block, per_interval.values(), strict=True)]
    once = _held(ranges, low, high).groupBy(F.col(low).cast("long").alias("_low"), F.least(F.col(high).cast("long"), F.lit(10**DIGITS - 1)).alias("_high"), *keys).agg(*[c.alias(n) for n, c in per_block.items()])
    asked = starts(ranges, low, high) if asked is None else asked
    own = asked.columns
    begins = asked.withColumn("cell", _div(F.col("start"), CELL_DIGITS))
    ends = once.select(F.explode(_ends(F.col("_low"), F.col("_high"))).alias("_p"), *names).select("_p.*", *names)
    # Whole cells between the ends: blocks of cells, met by the cells in which an interval begins.
    between = blocks(_div(F.col("_low"), CELL_DIGITS) + 1, _div(F.col("_high"), CELL_DIGITS) - 1, DIGITS - CELL_DIGITS)
    wide = once.withColumn("_wide", F.explode(between)).groupBy("_wide", *keys).agg(*again)
    cells = begins.select("cell").distinct().withColumn("_wide", F.explode(above(F.col("cell"), DIGITS - CELL_DIGITS)))
    whole = cells.join(wide, "_wide").select("cell", (F.col("cell") * CELL).alias("_low"), (F.col("cell") * CELL + (CELL - 1)).alias("_high"), *names)
    # Pieces and starts are dealt together, by cell alone; all that follows is grouped by cell and more.
    rows = ends.unionByName(whole).unionByName(begins, allowMissingColumns=True)
    rows = rows.repartition("cell") if parts is None else rows.repartition(parts, "cell")
    asks = F.col("start").isNotNull()
    at = F.when(asks, above(F.col("start"), CELL_DIGITS)).otherwise(blocks(F.col("_low"), F.col("_high"), CELL_DIGITS))
    summed = rows.withColumn("_block", F.explode(at)).groupBy("cell", "_block", *own, *keys).agg(*again)
    held = F.collect_list(F.when(~asks, F.struct(*names))).over(Window.partitionBy("cell", "_block"))
    found = summed.select("cell", *own, held.alias("_held")).where(asks).select("cell", *own, F.explode_outer("_held").alias("_h")).select("cell", *own, "_h.*")
    return found.groupBy("cell", *own, *keys).agg(*[c.alias(n) for n, c in per_interval.items()])


def locate(values: DataFrame, value: str, intervals: DataFrame) -> DataFrame:
    """``values``, whose ``value`` is distinct, with the columns of the interval each lies in; ``intervals`` has one row a ``start``."""
    names = [c for c in intervals.columns if c != "start"]
    cuts = intervals.select(F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(values.schema[value].dataType).alias(value), F.struct("start", *names).alias("_found"))
    asked = values.select(F.col(value).cast("long").alias("_at"), F.lit(1).alias("_kind"), value, F.lit(None).cast(cuts.schema["_found"].dataType).alias("_found"))
    order = Window.partitionBy(F.call_function("div", F.col("_at"), F.lit(BUCKET))).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = cuts.unionByName(asked).withColumn("_found", F.last("_found", ignorenulls=True).over(order))
    return both.where("_kind = 1").select(value, "_found.*")
