"""Scans of releases in sequence against comparing them two by two."""

from __future__ import annotations

from prefixlake.operators.changes import compare
from prefixlake.streaming import watch as w

FIELDS = {"network": "network_changed", "status": "status_changed"}
RELEASES = [
    [("1", "visa", "active"), ("2", "mc", "active"), ("3", None, "active"), ("5", "x", "y")],
    [("1", "visa", "retired"), ("3", "amex", "active"), ("4", "mc", "active"), ("5", "z", "y")],
    [("1", "visa", "retired"), ("2", "mc", "active"), ("3", "amex", None), ("4", "jcb", "active")],
]


def test_three_feeds_in_sequence(spark, tmp_path):
    frames = [spark.createDataFrame(r, "bin string, network string, status string") for r in RELEASES]
    watch = spark.createDataFrame([(k,) for k in ("1", "2", "3", "4", "6", "1")], "bin string")
    feed, place = f"file://{tmp_path}/feed", f"file://{tmp_path}/place"
    found = []
    for i, release in enumerate(frames):
        rows = w.watched_rows(release, watch, i + 1, FIELDS)
        rows.write.mode("append").parquet(feed)
        if i == 1:
            rows.write.mode("append").parquet(feed)  # delivered twice
        # Every scan is a new query from the checkpoint: a restart.
        found = w.scan(spark.readStream.schema(rows.schema).parquet(feed), FIELDS, place).collect()
    expected = []
    for i in (1, 2):
        expected += [(r["bin"], i + 1, r["change_type"], r["field"], r["previous_value"], r["current_value"], r["summary"]) for r in compare(frames[i - 1], frames[i], FIELDS, watch=watch).collect()]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str) and len(expected) == 7
