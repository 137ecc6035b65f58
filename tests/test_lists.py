"""One list read by many tasks: the same rows however the file is cut."""

from __future__ import annotations

import random

import pytest

from prefixlake.sources import lists


def written(tmp_path, name, seed, sections, rows):
    """A list of several sections: directives, comments, blank lines, other headers, other delimiters, CRLF."""
    rnd, out = random.Random(seed), ["﻿# a list", ""]
    for s in range(sections):
        d = rnd.choice(",;\t") if s else ","
        if rnd.random() < 0.6:
            out.append(f"# list: confidence = 0.{rnd.randrange(1, 9)}")
        if rnd.random() < 0.4:
            out.append("# list: Pays = " + rnd.choice(["accepted_in", "country"]))
        if rnd.random() < 0.3:
            out.append(f"# list: pad_short_bins = {rnd.choice(['true', 'no'])}")
        names = ["bin", "bank", rnd.choice(["Pays", "country", "phone"]), *rnd.choice([[], ["level"], ["level", "strange"]])]
        out.append(d.join(names))
        for _ in range(rnd.randrange(rows)):
            cells = [str(rnd.randrange(10**rnd.randrange(3, 9))), rnd.choice(["Alpha", f'"Beta{d} Inc"', "Gämma 漢"]), rnd.choice(["FR", "", "DE"]), *[rnd.choice(["Gold", ""]) for _ in names[3:]]]
            out.append(rnd.choice(["", "# note: nothing"]) if rnd.random() < 0.1 else d.join(cells))
    (tmp_path / name).write_bytes(rnd.choice(["\n", "\r\n"]).join(out).encode() + rnd.choice([b"", b"\n"]))


def rows(spark, path):
    got = lists.read_lists(spark, path)
    return sorted((r["file"], r["line"], sorted(r["values"].items()), sorted(r["original"].items()), r["confidence"], r["pad_short"], r["unknown"]) for r in got.collect()), got


@pytest.mark.parametrize("cut", [40, 200, 3000])
def test_splits_do_not_show(spark, tmp_path, cut):
    for i in range(4):
        written(tmp_path, f"list{i}.csv", i, 12, 40)
    whole, _ = rows(spark, f"file://{tmp_path}")
    assert len(whole) > 500
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(cut))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        parts, got = rows(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 4
        assert parts == whole
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_files_of_one_name_are_apart(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"d{i}").mkdir()
    (tmp_path / "d0/x.csv").write_text("bin,bank\n414720,A\n")
    (tmp_path / "d1/x.csv").write_text("bank;bin\nB;510001\n\n\nC;510002\n")
    got = lists.read_lists(spark, f"file://{tmp_path}/*").collect()
    assert sorted((r["file"], r["line"], r["values"]["bin"], r["values"]["bank"]) for r in got) == [("x.csv", 2, "414720", "A"), ("x.csv", 2, "510001", "B"), ("x.csv", 5, "510002", "C")]


def test_nothing_but_comments(spark, tmp_path):
    (tmp_path / "x.csv").write_text("# only\n\n   \n")
    (tmp_path / "y.csv").write_text("")
    assert lists.read_lists(spark, f"file://{tmp_path}").count() == 0
