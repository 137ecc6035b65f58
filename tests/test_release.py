"""Releases under several publishers, and readers meanwhile."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from prefixlake.sources.atomic import put_if_absent
from prefixlake.sources.release import ReleaseConflict, Releases


@pytest.fixture
def held(spark, tmp_path):
    return Releases(spark, f"file://{tmp_path}/releases")


def numbered(spark, n):
    return {"bins": spark.range(n).select(F.col("id"), F.lit(n).alias("n")), "more": spark.range(1).select(F.lit(n).alias("n"))}


def test_a_name_is_given_once(spark, tmp_path):
    path, wrote = f"file://{tmp_path}/a/x.json", []
    crowd = [threading.Thread(target=lambda i=i: wrote.append((put_if_absent(spark, path, f"text {i}" * 1000), i))) for i in range(16)]
    [t.start() for t in crowd], [t.join() for t in crowd]
    won = [i for ok, i in wrote if ok]
    assert len(won) == 1 and (tmp_path / "a/x.json").read_text() == f"text {won[0]}" * 1000
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x.json"]


def test_a_name_is_given_once_through_hadoop(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.put.link./in", f"file://{tmp_path}/in")
    assert put_if_absent(spark, "viewfs://put/in/y.json", "one") and not put_if_absent(spark, "viewfs://put/in/y.json", "two")
    assert (tmp_path / "in/y.json").read_text() == "one"


def test_of_two_publishers_one_wins(spark, held):
    held.write("1", numbered(spark, 10))
    held.publish("1", "t1")
    seen = held.seen()
    for v, n in (("2", 20), ("3", 30)):
        held.write(v, numbered(spark, n))
    got = {}

    def go(v):
        try:
            got[v] = held.publish(v, "t2", seen)
        except ReleaseConflict as error:
            got[v] = error

    both = [threading.Thread(target=go, args=(v,)) for v in ("2", "3")]
    [t.start() for t in both], [t.join() for t in both]
    won = [v for v, x in got.items() if x == 2]
    assert len(won) == 1 and held.live() == won[0] and held.seen() == 2
    lost = ({"2", "3"} - set(won)).pop()
    assert isinstance(got[lost], ReleaseConflict)
    assert held.publish(lost, "t3") == 3 and held.live() == lost  # it may look again and follow


def test_readers_keep_one_whole_release(spark, held):
    held.write("1", numbered(spark, 10))
    held.publish("1", "t1")
    before = held.tables()
    held.write("2", numbered(spark, 20))
    half = held.tables()
    held.publish("2", "t2")
    for tables in (before, half):
        assert {tables["bins"].first()["n"], tables["more"].first()["n"]} == {10}
    assert {held.tables()["bins"].first()["n"], held.tables()["more"].first()["n"]} == {20}


def test_published_versions_are_never_rewritten(spark, held):
    held.write("1", numbered(spark, 10))
    held.write("1", numbered(spark, 12))  # not published yet: the last to be written counts
    held.publish("1", "t1")
    assert held.table("bins").count() == 12
    with pytest.raises(ValueError, match="can't be written again"):
        held.write("1", numbered(spark, 11))
    with pytest.raises(ValueError, match="no release"):
        held.publish("9", "t2")
    assert held.live() == "1" and [r["action"] for r in held.lineage().collect()] == ["publish"]


def test_rollback_is_an_entry_and_can_conflict(spark, held):
    with pytest.raises(ValueError, match="no release to go back to"):
        held.rollback("t0")
    for v, n in (("1", 10), ("2", 20)):
        held.write(v, numbered(spark, n))
        held.publish(v, f"t{v}")
    seen = held.seen()
    assert held.rollback("t3", seen) == "1" and held.table("bins").count() == 10
    with pytest.raises(ReleaseConflict):
        held.rollback("t3", seen)
    assert [tuple(r) for r in held.log().orderBy("number").select("number", "action", "version").collect()] == [(1, "publish", "1"), (2, "publish", "2"), (3, "rollback", "1")]


def test_a_damaged_release_is_not_published(spark, held, tmp_path):
    held.write("1", numbered(spark, 10))
    folder = held._find("1")["folder"]
    numbered(spark, 3)["bins"].write.mode("overwrite").parquet(f"{held.root}/{folder}/bins")
    with pytest.raises(ValueError, match="does not verify"):
        held.publish("1", "t1")
    assert held.live() is None
