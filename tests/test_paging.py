"""Pages by seeking against sorting and skipping; figures carried forward against counting anew."""

from __future__ import annotations

import random

import pytest

from prefixlake.operators import analytics, paging, search


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(1)
    rows = [(i, str(400000 + rnd.randrange(50)), rnd.choice([None, "FR", "DE", "US"])) for i in range(700)]
    return spark.createDataFrame(rows, "id long, bin string, country string").repartition(7)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("column", ["country", "bin", "no such"])
def test_pages_and_cursors(spark, table, column, descending):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pages = paging.paged(table, column, descending)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert pages.total == 700 and len(pages.starts) > 1
    whole = [tuple(r) for r in search.page(table, column, descending, 1, 500).collect()] + [tuple(r) for r in search.page(table, column, descending, 2, 500).collect()]
    for n, size in ((1, 50), (7, 50), (14, 50), (15, 50), (2, 300), (3, 299), (700, 1)):
        assert [tuple(r) for r in pages.page(n, size).collect()] == whole[(n - 1) * size : n * size]
    seen, cursor = [], None
    while some := pages.after(cursor, 90).collect():
        seen += [tuple(r) for r in some]
        cursor = some[-1]
    assert seen == whole
    assert pages.info(8, 100) == {"total": 700, "pages": 7, "first": 0, "last": 0, "has_next": False, "has_previous": True}


def test_a_late_page_reads_its_own_part(table):
    pages = paging.paged(table, "country")
    plan = pages.page(60, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "_at" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "Exchange" not in plan or plan.count("Exchange") == plan.count("Exchange rangepartitioning")


def test_no_rows(table):
    pages = paging.paged(table.limit(0), "country")
    assert pages.total == 0 and pages.page().count() == 0 and pages.after(None).count() == 0


def test_figures_after_rows_came_and_went(spark):
    shape = "id long, network_id int, country_id int, is_prepaid boolean, status string"
    rnd = random.Random(2)
    row = lambda i: (i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, 7, 8]), rnd.choice([None, True, False]), rnd.choice(["active", "retired"]))
    releases = [[row(i) for i in range(40)], [row(i) for i in range(10, 60)], [(1, None, None, None, None)], [], [row(i) for i in range(5)]]
    frames = [spark.createDataFrame(r, shape) for r in releases]
    state = analytics.partials(frames[0])
    for before, after in zip(frames, frames[1:]):  # noqa: B905
        state = analytics.maintained(state, *analytics.delta(before, after))
        assert sorted(map(tuple, analytics.figures(state).collect())) == sorted(map(tuple, analytics.statistics(after).where("value is not null").collect() if after.count() else []))
