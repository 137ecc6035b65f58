"""SQLite files as a Spark data source: intervals of row numbers, each read in a task of its own.

``spark.read.format("prefixlake_sqlite").load(path)``; options ``table`` (by default the table that looks
most like a list of prefixes) and ``split_mb``. The driver reads the schema and the bounds of the row
numbers, nothing else. The file must lie in a folder that all machines mount, and must not change while
it is read. Every value is text, null stays null; a table without row numbers is one split.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

NAME = "prefixlake_sqlite"
BATCH = 10_000


def opened(path: str) -> sqlite3.Connection:
    """A read-only connection; ``path`` may be a ``file:`` address."""
    local = unquote(urlparse(path).path) if path.startswith("file:") else path
    return sqlite3.connect(f"file:{quote(local)}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def best_table(db: sqlite3.Connection, wanted: str | None = None) -> tuple[str, list[str]]:
    """A table and its columns: the one wanted, one named as a list, or the one with most columns of a record."""
    from prefixlake.sources.readers import FIELD_NAMES, folded

    known = {n for names in FIELD_NAMES.values() for n in names}
    names = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' order by name")]
    columns = {t: [r[1] for r in db.execute(f"pragma table_info({quoted(t)})")] for t in names}
    score = {t: len({folded(x) for x in c} & known) + 5 * bool({folded(x) for x in c} & {"bin", "iin", "bin_number"}) for t, c in columns.items()}
    best = wanted or next((t for t in ("bins", "bin_list", "binlist") if t in names and score[t]), None) or max(names, key=lambda t: score[t], default=None)
    if best is None or not columns.get(best) or not (wanted or score[best]):
        raise ValueError("no table looks like a list of prefixes")
    return best, columns[best]


def text_batches(rows: sqlite3.Cursor, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """What a cursor gives, as text columns, some thousand rows at a time."""
    while some := rows.fetchmany(BATCH):
        cells = [[None if v is None else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in column] for column in zip(*some, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names=columns)


@dataclass
class Rows(InputPartition):
    """Row numbers from ``first`` to ``last``; None for a table that has none."""

    first: int | None
    last: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], split_mb: float) -> None:
        self.path, self.table, self.columns, self.split_mb = path, table, columns, split_mb

    def partitions(self) -> list[Rows]:
        with opened(self.path) as db:
            try:
                first, last = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # made without row numbers
                return [Rows(None, None)]
        if first is None:
            return [Rows(0, -1)]
        size = os.path.getsize(unquote(urlparse(self.path).path) if self.path.startswith("file:") else self.path)
        n = max(1, min(last - first + 1, int(size / (self.split_mb * (1 << 20))) + 1))
        edges = [first + (last - first + 1) * i // n for i in range(n + 1)]
        return [Rows(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        where = "" if partition.first is None else f" where rowid between {partition.first} and {partition.last}"
        with opened(self.path) as db:
            yield from text_batches(db.execute(f"select {', '.join(map(quoted, self.columns))} from {quoted(self.table)}{where}"), self.columns)


class SqliteSource(DataSource):
    """A table of a SQLite file."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _found(self) -> tuple[str, list[str]]:
        with opened(self.options["path"]) as db:
            return best_table(db, self.options.get("table"))

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self._found()[1]])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], *self._found(), float(self.options.get("split_mb", "32")))


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session."""
    spark.dataSource.register(SqliteSource)
    return spark
