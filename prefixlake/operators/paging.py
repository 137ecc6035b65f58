"""Pages by seeking: a sorted copy of a result with a directory of its parts (L1, L2, L3).

Sorting is paid once. Afterwards a page is a filter on one or two parts and the row numbers in them, both
of which reach the Parquet scan, so page 1 000 costs what page 1 does; a cursor (the last row seen) finds
its part in the directory in the same way. The directory has one row a part and is all the driver holds.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from prefixlake.operators.search import MAX_PAGE, SORTABLE, page_info
from prefixlake.session import shared_folder


def _order(sort_by: str, descending: bool) -> list[Column]:
    """The total order of :func:`prefixlake.operators.search.page`."""
    column = F.col(sort_by)
    return [column.desc_nulls_last() if descending else column.asc_nulls_first(), F.col("bin").asc(), F.col("id").asc()]


@dataclass(frozen=True)
class Pages:
    """A sorted copy at ``place``; ``starts`` is the row number of each part's first row, ``firsts`` that row's key."""

    spark: SparkSession
    place: str
    sort_by: str
    descending: bool
    starts: list[int]
    firsts: list[tuple]
    total: int

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.place)

    def page(self, page: int = 1, size: int = 50) -> DataFrame:
        """One page in order; empty beyond the end."""
        size = max(1, min(MAX_PAGE, size))
        first = (max(1, page) - 1) * size
        last = min(first + size, self.total) - 1
        if last < first:
            return self._rows().where("false").drop("_part", "_at")
        here, there = bisect_right(self.starts, first) - 1, bisect_right(self.starts, last) - 1
        wanted = F.lit(False)
        for p in range(here, there + 1):
            wanted = wanted | ((F.col("_part") == p) & F.col("_at").between(max(0, first - self.starts[p]), last - self.starts[p]))
        return self._rows().where(wanted).orderBy("_part", "_at").drop("_part", "_at")

    def after(self, cursor: Row | None, size: int = 50) -> DataFrame:
        """The rows that follow ``cursor``, a row of an earlier page; from the start without one."""
        if cursor is None:
            return self.page(1, size)
        key = self._key(cursor)
        here = max(0, bisect_right(self.firsts, key) - 1)
        rows, value, column = self._rows().where(F.col("_part") >= here), cursor[self.sort_by], F.col(self.sort_by)
        tie = (F.col("bin") > cursor["bin"]) | ((F.col("bin") == cursor["bin"]) & (F.col("id") > cursor["id"]))
        if value is None:
            later = (column.isNull() & tie) if self.descending else (column.isNotNull() | tie)
        else:
            beyond = (column < F.lit(value)) | column.isNull() if self.descending else column > F.lit(value)
            later = beyond | ((column == F.lit(value)) & tie)
        # Parts after the cursor's are needed only where its own holds too few rows.
        enough = bisect_right(self.starts, self.starts[here] + MAX_PAGE + self._longest(here))
        return rows.where((F.col("_part") <= enough) & later).orderBy("_part", "_at").limit(max(1, min(MAX_PAGE, size))).drop("_part", "_at")

    def _longest(self, part: int) -> int:
        return (self.starts[part + 1] if part + 1 < len(self.starts) else self.total) - self.starts[part]

    def _key(self, row: Row) -> tuple:
        return _comparable(row[self.sort_by], row["bin"], row["id"], self.descending)

    def info(self, page: int, size: int) -> dict[str, int | bool]:
        """Page arithmetic (L3)."""
        return page_info(self.total, page, max(1, min(MAX_PAGE, size)))


class _Backwards:
    """A value that sorts the other way round."""

    def __init__(self, value: object) -> None:
        self.value = value

    def __lt__(self, other: _Backwards) -> bool:
        return other.value < self.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Backwards) and self.value == other.value


def _comparable(value: object, bin: str, id: int, descending: bool) -> tuple:
    missing = value is None
    if descending:
        return (missing, _Backwards("" if missing else value) if not missing else 0, bin, id)
    return (not missing, 0 if missing else value, bin, id)


def paged(df: DataFrame, sort_by: str = "bin", descending: bool = False) -> Pages:
    """``df`` (with bin and id) sorted once into the shared folder, ready to be paged. Unknown sort columns fall back to the prefix."""
    spark = df.sparkSession
    sort_by = sort_by if sort_by in SORTABLE and sort_by in df.columns else "bin"
    order, place = _order(sort_by, descending), f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.select(*df.columns, F.shiftright("_place", 33).cast("int").alias("_part"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    placed.write.parquet(f"{place}/sorted")
    back = spark.read.parquet(f"{place}/sorted")
    parts = back.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col(sort_by).alias("s"), "bin", "id"), "_at").alias("first")).orderBy("_part").collect()
    # Parts are numbered anew without gaps and become folders, so a page reads no other files.
    number = {p["_part"]: i for i, p in enumerate(parts)}
    if parts:
        dense = F.element_at(F.create_map(*[F.lit(x) for kv in number.items() for x in kv]), F.col("_part"))
        back.withColumn("_part", dense).sortWithinPartitions("_part", "_at").write.partitionBy("_part").parquet(f"{place}/parts")
    else:
        back.withColumn("_part", F.lit(0)).write.parquet(f"{place}/parts")
    ends = list(accumulate(p["n"] for p in parts))
    firsts = [_comparable(p["first"]["s"], p["first"]["bin"], p["first"]["id"], descending) for p in parts]
    return Pages(spark, f"{place}/parts", sort_by, descending, [0, *ends[:-1]] if parts else [], firsts, ends[-1] if ends else 0)
