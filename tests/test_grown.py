"""Queries over keys beyond those of the smallest tables, against their oracles: longer prefixes, other leading digits."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from prefixlake.plans import all_queries
from prefixlake.plans.domain import TABLES

from .test_parity import rows

KEYS = {"part": ["p_partkey"], "customer": ["c_custkey"], "orders": ["o_custkey"], "lineitem": ["l_partkey"]}


@pytest.fixture(scope="module")
def moved(sf_dir, tmp_path_factory):
    """The smallest tables with the keys of prefixes and queries moved by a whole number of 100s."""

    def make(by):
        folder = tmp_path_factory.mktemp("moved")
        for t in TABLES:
            table = pq.read_table(f"{sf_dir}/{t}.parquet")
            for c in KEYS.get(t, ()):
                table = table.set_column(table.column_names.index(c), c, pc.add(table[c], pa.scalar(by, pa.int64())))
            pq.write_table(table, f"{folder}/{t}.parquet")
        return str(folder)

    return {by: make(by) for by in (9_800, 119_900, 650_000)}


def same(name, spark, folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    ours = all_queries.queries()[name](spark, folder)
    theirs = con.sql(all_queries.oracles()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, [list(r) for r in ours.collect()]) == rows(theirs.columns, theirs.fetchall())


def test_nine_digits_are_shown_in_two_groups(spark, moved):
    same("display_forms", spark, moved[650_000])


@pytest.mark.parametrize("by", [119_900, 650_000])
def test_all_digits_have_a_scheme_of_the_catalogue(by, spark, moved):
    same("enrich_currency", spark, moved[by])


@pytest.mark.parametrize("by", [119_900, 650_000])
def test_events_name_the_scheme_of_the_catalogue(by, spark, moved):
    same("enrich_events", spark, moved[by])


def test_lists_of_nine_digits_are_imported(spark, moved):
    same("list_import", spark, moved[650_000])


def test_lists_of_nine_digits_are_counted(spark, moved):
    same("list_report", spark, moved[650_000])


def test_rows_of_nine_digits_keep_their_origin(spark, moved):
    same("origin_rows", spark, moved[650_000])


def test_a_value_that_moves_between_columns_is_a_change(spark, moved):
    # Prefix 9828 loses country 3 and gains network 3.
    same("maintained_statistics", spark, moved[9_800])
