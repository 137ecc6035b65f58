"""Releases: immutable Parquet folders, and a log that says which one is live (S15, S16, I17, A23, A24, 2.M).

A release is written into a folder of its own, checked, and made live by the next entry of the log. Log
entries are numbered files that are put only if absent, so of two publishers that saw the same head one
wins and the other gets :class:`ReleaseConflict` and may look again. Nothing that an entry names is ever
written again: a reader that holds an entry reads one whole release, whatever is published meanwhile.
Tables and the log are read through Spark.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from prefixlake.sources.atomic import put_if_absent

SCHEMA_VERSION, OLDEST, SHRINK = 4, 1, 0.5
ENTRY = "number long, action string, version string, folder string, published_at string, record_count long, prefixes long"


class ReleaseConflict(RuntimeError):
    """Somebody else published since the head that this publisher saw."""


def _checksum(df: DataFrame) -> list:
    """Rows and an order-free checksum: the sum of row hashes, combined map-side; hashes pass over nulls, so those are told apart."""
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns]).cast("decimal(38,0)")).cast("string").alias("checksum")]


@dataclass(frozen=True)
class Releases:
    """The releases below one folder."""

    spark: SparkSession
    root: str

    # -- the log ---------------------------------------------------------------
    def log(self) -> DataFrame:
        """All entries (number, action, version, folder, published_at, record_count, prefixes)."""
        return self._entries("log")

    def _entries(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(ENTRY).json(f"{self.root}/{name}")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], ENTRY)
            raise

    def head(self) -> Row | None:
        """The entry that says what is live."""
        return self.log().orderBy(F.desc("number")).first()

    def seen(self) -> int:
        """The head's number, 0 before the first release."""
        head = self.head()
        return head["number"] if head else 0

    def _append(self, seen: int, **entry: object) -> None:
        if not put_if_absent(self.spark, f"{self.root}/log/{seen + 1:020d}.json", json.dumps({"number": seen + 1, **entry})):
            raise ReleaseConflict(f"release {entry['version']}: entry {seen + 1} of the log was written by another publisher")

    # -- writing ---------------------------------------------------------------
    def write(self, version: str, tables: dict[str, DataFrame], prefixes: str = "bins", allow_shrink: bool = False) -> DataFrame:
        """Write and verify a release in a folder of its own; returns its manifest. It is not live yet.

        A version that was published stays as it is: writing it again is refused. So is a release with
        under half the live one's prefixes, unless ``allow_shrink``.
        """
        if self.log().where(F.col("version") == version).count():
            raise ValueError(f"release {version} was published and can't be written again")
        folder = f"{version}/{uuid.uuid4().hex}"
        for name, df in sorted(tables.items()):
            df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}/{name}")
        self._describe(folder, version, sorted(tables))
        new = self.spark.read.parquet(f"{self.root}/{folder}/{prefixes}").count() if prefixes in tables else None
        live = self.head()
        if live and live["prefixes"] and new is not None and not allow_shrink and new < SHRINK * live["prefixes"]:
            raise ValueError(f"release {version} has {new} prefixes, the live one {live['prefixes']}: not published")
        self._stage(version, folder, new)
        return self.manifest(version)

    def _describe(self, folder: str, version: str, names: list[str]) -> None:
        parts = []
        for name in names:
            back = self.spark.read.parquet(f"{self.root}/{folder}/{name}")
            parts.append(back.agg(F.lit(name).alias("table"), *_checksum(back)))
        manifest = parts[0]
        for p in parts[1:]:
            manifest = manifest.unionByName(p)
        manifest.withColumns({"version": F.lit(version), "schema_version": F.lit(SCHEMA_VERSION)}).coalesce(1).write.parquet(f"{self.root}/{folder}/_manifest")

    def _stage(self, version: str, folder: str, prefixes: int | None) -> None:
        """Remember where the version was written; the last to finish counts until one is published."""
        number = self._entries("staged").agg(F.max("number")).first()[0] or 0
        entry = {"action": "stage", "version": version, "folder": folder, "prefixes": prefixes}
        while not put_if_absent(self.spark, f"{self.root}/staged/{number + 1:020d}.json", json.dumps({"number": number + 1, **entry})):
            number += 1

    def _find(self, version: str) -> Row:
        """The entry of a version: where it was published, else where it was staged last."""
        for entries in (self.log(), self._entries("staged")):
            found = entries.where(F.col("version") == version).orderBy(F.desc("number")).first()
            if found:
                return found
        raise ValueError(f"there is no release {version}")

    def manifest(self, version: str) -> DataFrame:
        """(table, rows, checksum, version, schema_version) of a release."""
        return self.spark.read.parquet(f"{self.root}/{self._find(version)['folder']}/_manifest")

    def verify(self, version: str) -> bool:
        """Whether every table still has the rows and the checksum of the manifest."""
        return self._whole(self._find(version)["folder"])

    def _whole(self, folder: str) -> bool:
        for r in self.spark.read.parquet(f"{self.root}/{folder}/_manifest").collect():  # one row a table
            if not OLDEST <= r["schema_version"] <= SCHEMA_VERSION:
                return False
            df = self.spark.read.parquet(f"{self.root}/{folder}/{r['table']}")
            got = df.agg(*_checksum(df)).first()
            if (got["rows"], got["checksum"]) != (r["rows"], r["checksum"]):
                return False
        return True

    # -- publishing ------------------------------------------------------------
    def publish(self, version: str, at: str, seen: int | None = None, action: str = "publish") -> int:
        """Make a release live by the log's next entry, if it verifies; returns the entry's number.

        ``seen`` is the head that the release was made against (:meth:`seen`; by default the head now).
        If the log has gone on since, :class:`ReleaseConflict` is raised and nothing changes.
        """
        seen = self.seen() if seen is None else seen
        found = self._find(version)
        if not self._whole(found["folder"]):
            raise ValueError(f"release {version} does not verify")
        rows = self.spark.read.parquet(f"{self.root}/{found['folder']}/_manifest").agg(F.sum("rows")).first()[0]
        self._append(seen, action=action, version=version, folder=found["folder"], published_at=at, record_count=rows, prefixes=found["prefixes"])
        return seen + 1

    def live(self) -> str | None:
        """The version published last."""
        head = self.head()
        return head["version"] if head else None

    def rollback(self, at: str, seen: int | None = None) -> str:
        """Publish the release again that was live before the live one came."""
        seen = self.seen() if seen is None else seen
        entries = self.log().where(F.col("number") <= seen)
        live = entries.orderBy(F.desc("number")).first()
        row = entries.where(F.col("version") != live["version"]).orderBy(F.desc("number")).first() if live else None
        if row is None:
            raise ValueError("there is no release to go back to")
        self.publish(row["version"], at, seen, "rollback")
        return row["version"]

    # -- reading ---------------------------------------------------------------
    def table(self, name: str, version: str | None = None) -> DataFrame:
        """One table, of the live release by default. For several tables of one release use :meth:`tables`."""
        folder = self._find(version)["folder"] if version else self.head()["folder"]
        return self.spark.read.parquet(f"{self.root}/{folder}/{name}")

    def tables(self, version: str | None = None) -> dict[str, DataFrame]:
        """Every table of one release, all from the same entry of the log."""
        folder = self._find(version)["folder"] if version else self.head()["folder"]
        names = [r["table"] for r in self.spark.read.parquet(f"{self.root}/{folder}/_manifest").collect()]
        return {n: self.spark.read.parquet(f"{self.root}/{folder}/{n}") for n in names}

    def lineage(self, limit: int = 12) -> DataFrame:
        """What was published, newest first."""
        return self.log().orderBy(F.desc("number")).select("version", "published_at", "record_count", "action").limit(limit)

    def info(self) -> DataFrame:
        """(version, tables, rows, healthy) of the live release."""
        live = self.live()
        if live is None:
            return self.spark.createDataFrame([], "version string, tables long, rows long, healthy boolean")
        return self.manifest(live).groupBy("version").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows"), (F.sum(F.when(F.col("table") == "bins", F.col("rows")).otherwise(0)) > 0).alias("healthy"))

    # -- copies ----------------------------------------------------------------
    def backup(self, target: str, version: str | None = None) -> str:
        """Copy a release elsewhere, table by table (S16); returns where."""
        entry = self._find(version) if version else self.head()
        held = Releases(self.spark, target)
        folder = f"{entry['version']}/{uuid.uuid4().hex}"
        for name, df in self.tables(entry["version"]).items():
            df.write.parquet(f"{target}/{folder}/{name}")
        self.manifest(entry["version"]).coalesce(1).write.parquet(f"{target}/{folder}/_manifest")
        held._stage(entry["version"], folder, entry["prefixes"])
        return f"{target}/{folder}"

    def restore(self, source: str, version: str, at: str, seen: int | None = None) -> None:
        """Bring a backup back under a folder of its own and publish it, if it verifies."""
        seen = self.seen() if seen is None else seen
        held = Releases(self.spark, source)
        if not held.verify(version):
            raise ValueError(f"backup {version} does not verify")
        folder = f"{version}/{uuid.uuid4().hex}"
        for name, df in held.tables(version).items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        held.manifest(version).coalesce(1).write.parquet(f"{self.root}/{folder}/_manifest")
        if not self._whole(folder):
            raise ValueError(f"the copy of backup {version} does not verify")
        rows = self.spark.read.parquet(f"{self.root}/{folder}/_manifest").agg(F.sum("rows")).first()[0]
        self._append(seen, action="restore", version=version, folder=folder, published_at=at, record_count=rows, prefixes=held._find(version)["prefixes"])


def backfill(bins: DataFrame, from_version: int) -> DataFrame:
    """Columns that older schemas lack, derived as the later ones define them (2.M migrations)."""
    if not OLDEST <= from_version <= SCHEMA_VERSION:
        raise ValueError(f"schema {from_version} can't be migrated")
    from prefixlake.functions.digits import prefix_parts

    for name, c in prefix_parts(F.col("bin")).items():
        if name not in bins.columns:
            bins = bins.withColumn(name, c)
    return bins
