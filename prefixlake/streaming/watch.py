"""Watched targets across releases: the last snapshot of each is kept as keyed state.

A feed has one row for each watched target and release: what it looks like there, or that it is absent.
A target met for the first time is remembered and gives no event, as there is nothing to compare it
with; later rows are compared with what is remembered. Only the pairing is stateful; what counts as a
change is the same expression as for two releases at hand (:func:`prefixlake.operators.changes.events`).
The state lives in the query's checkpoint, so a scan goes on where the last one ended, restarts included;
a release that is delivered again, or late, changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prefixlake.operators.changes import events
from prefixlake.session import on_workers

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


class LastSnapshot(StatefulProcessor):
    """Keeps the newest release's snapshot of a target; gives (target, release, before, after) for each later one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "release long, snapshot string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self._last.get() if self._last.exists() else None
        release, snapshot = (held[0], held[1]) if held else (None, None)
        for row in sorted(rows, key=lambda r: r["release"]):  # a few releases at most
            if release is not None and row["release"] <= release:
                continue
            if release is not None:
                yield Row(target=key[0], release=row["release"], before=snapshot, after=row["snapshot"])
            release, snapshot = row["release"], row["snapshot"]
        if release is not None:
            self._last.update((release, snapshot))

    def close(self) -> None:
        pass


def watched_rows(release: DataFrame, watch: DataFrame, number: int, fields: dict[str, str], target: str = "bin") -> DataFrame:
    """(target, release, snapshot): a release as its watched targets see it; an absent one has no snapshot."""
    state = release.select(target, F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), {"ignoreNullFields": "false"}).alias("snapshot"))
    keys = watch.select(target).distinct()
    return keys.join(state, target, "left").select(F.col(target).cast("string").alias("target"), F.lit(number).cast("long").alias("release"), "snapshot")


def scan(feed: DataFrame, fields: dict[str, str], place: str, target: str = "bin") -> DataFrame:
    """All events found so far by scanning the rows there are now of a streamed ``feed`` (target, release, snapshot).

    ``place`` is a shared folder that keeps the state and the events; call again when releases came.
    """
    spark = on_workers(feed.sparkSession)
    pairs = feed.groupBy("target").transformWithState(LastSnapshot(), "target string, release long, before string, after string", "Append", "None")
    shape = ", ".join(f"{f} string" for f in fields)
    both = pairs.select(F.col("target").alias(target), "release", F.from_json("before", shape).alias("_old"), F.from_json("after", shape).alias("_new")).where("_old is not null or _new is not null")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/events/batch={batch}")  # the same folder if the batch is run again

    before = spark.conf.get(_PROVIDER_KEY)
    spark.conf.set(_PROVIDER_KEY, PROVIDER)
    try:
        query = events(both, fields, target, ("release",)).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER_KEY, before)
    query.awaitTermination()
    return spark.read.schema(f"{target} string, release long, change_type string, field string, previous_value string, current_value string, summary string, batch int").option("basePath", f"{place}/events").parquet(f"{place}/events").drop("batch")
