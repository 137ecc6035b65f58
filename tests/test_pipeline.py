"""Merge folds, enrichment, changes, ledgers, workspaces and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.operators import analytics, changes, pipeline, search, workspace
from prefixlake.streaming import facade


def test_merge_prefers_current_and_better_evidence(spark):
    rows = [
        ("414720", 1, "visa", "US", 0.8, True),
        ("414720", 2, "visa", "GB", 0.8, True),  # equal confidence, but a current issuer is known: stays
        ("414720", 3, None, "DE", 0.9, False),  # better, but past: recorded only
        ("414720", 4, None, "FR", 0.95, True),  # better and current: wins
        ("510001", 1, "", "US", 0.5, False),
        ("510001", 2, "mastercard", "CA", 0.5, True),  # as good, and the first current claim: wins
    ]
    df = spark.createDataFrame(rows, "bin string, line int, network string, country string, confidence double, current boolean")
    got = {r["bin"]: r for r in pipeline.merge_fields(df, "bin", ["line"], ["network", "country"]).collect()}
    a, b = got["414720"], got["510001"]
    assert (a["network"], a["country"], a["confidence"]) == ("visa", "FR", 0.95)
    assert [(c["value_a"], c["value_b"]) for c in a["conflicts"]] == [("US", "GB"), ("US", "DE"), ("US", "FR")]
    assert (b["network"], b["country"]) == ("mastercard", "CA")


def test_fact_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, line int, v string")
    once = pipeline.fact_dedup(df, ["k"], ["line"])
    assert sorted((r["k"], r["v"], r["line"], r["copies"]) for r in once.collect()) == [("a", "y", 1, 2), ("b", "z", 3, 1)]
    again = pipeline.fact_dedup(once.drop("copies"), ["k"], ["line"])
    assert sorted(map(tuple, again.drop("copies").collect())) == sorted(map(tuple, once.drop("copies").collect()))


def test_change_summaries(spark):
    old = spark.createDataFrame([("1", "A", "credit", "x"), ("2", "B", "debit", ""), ("3", "C", "debit", None)], "bin string, institution string, card_type string, city string")
    new = spark.createDataFrame([("1", "A", "deferred_debit", None), ("2", "B", "debit", None), ("4", "D", "debit", None)], "bin string, institution string, card_type string, city string")
    fields = {k: changes.BIN_FIELDS[k] for k in ("institution", "card_type", "city")}
    got = {(r["bin"], r["change_type"]): r["summary"] for r in changes.compare(old, new, fields).collect()}
    assert got == {
        ("1", "card_type_changed"): "BIN 1: card type changed from Credit to Deferred Debit.",
        ("1", "location_changed"): "BIN 1: city is no longer recorded (was X).",
        ("3", "bin_removed"): "BIN 3 is no longer present in the database.",
        ("4", "bin_added"): "BIN 4 has been added to the database.",
    }


def test_pages_walk_every_row_once(spark):
    rows = spark.range(53).select("id", (F.col("id") * 7 % 11).cast("string").alias("bin"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("country"))
    seen = [r["id"] for p in range(1, 7) for r in search.page(rows, "country", page=p, size=10).collect()]
    assert sorted(seen) == list(range(53))
    assert search.page_info(53, 6, 10) == {"total": 53, "pages": 6, "first": 51, "last": 53, "has_next": False, "has_previous": True}


def test_describe_is_stable():
    assert search.AdvancedQuery().is_empty and search.AdvancedQuery(card_type="credit", region="x").describe() == ["card type: credit", "region: x"]


def test_expand_graph_ends_on_cycles(spark):
    inst = spark.createDataFrame([(i, None) for i in range(6)], "id long, parent_id long")
    edges = spark.createDataFrame([(0, 1, "subsidiary"), (1, 0, "subsidiary"), (1, 2, "brand_of"), (2, 3, "predecessor"), (3, 4, "subsidiary"), (4, 5, "subsidiary"), (0, 5, "processor_for")], "institution_id long, related_institution_id long, relationship_type string")
    got = analytics.contributing(inst, edges, spark.createDataFrame([(0,)], "root long")).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3, 4]


def test_workspace(spark):
    state = spark.createDataFrame([("Mine", False), ("Other", True)], "name string, pinned boolean")
    new = workspace.upsert(state, spark.createDataFrame([("mine", True)], "name string, pinned boolean"), ["name"])
    assert [r["name"] for r in workspace.saved_searches(new).collect()] == ["mine", "Other"]
    h = spark.createDataFrame([("u", "a", 1), ("u", "b", 2)], "user string, query string, at int")
    more = workspace.add_history(h, spark.createDataFrame([("u", "a", 3)], "user string, query string, at int"), cap=2)
    assert sorted((r["query"], r["at"]) for r in more.collect()) == [("a", 3), ("b", 2)]
    fav = spark.createDataFrame([("1",)], "bin string")
    assert sorted(r["bin"] for r in workspace.toggle(fav, spark.createDataFrame([("1",), ("2",)], "bin string"), ["bin"]).collect()) == ["2"]
    lists = spark.createDataFrame([("l",), ("m",)], "watchlist string")
    items = spark.createDataFrame([("l", "1"), ("l", "2")], "watchlist string, bin string")
    events = spark.createDataFrame([("l", False), ("l", True)], "watchlist string, acknowledged boolean")
    assert sorted(map(tuple, workspace.watchlist_counts(lists, items, events).collect())) == [("l", 2, 1), ("m", 0, 0)]
    assert workspace.acknowledge(events, "l").where("not acknowledged").count() == 0


def test_stream_of_claims(spark, tmp_path, sf_dir):
    from prefixlake.plans.domain import frame

    frame(spark, sf_dir, "bx_claims").repartition(3).write.parquet(f"file://{tmp_path}/in")
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    stream = facade.read_feed(spark, f"file://{tmp_path}/in", schema, "parquet")
    q = facade.request_budget(stream.select(F.col("observed_at").alias("at"), F.col("field").alias("source"))).writeStream.format("memory").queryName("budget").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(requests) from budget").first()[0] == frame(spark, sf_dir, "bx_claims").count()
    seen = []
    q = facade.stage_batches(stream, lambda df, n: seen.append(df.count()), f"file://{tmp_path}/cp")
    q.awaitTermination()
    assert sum(seen) == frame(spark, sf_dir, "bx_claims").count()


def test_core_names_merge_on_their_own_evidence_whatever_the_least_id_is(spark):
    """The least id of a name is in another country; the two others share a prefix and are one institution."""
    rows = [(1, "First Union Bank", 1), (2, "First Union Bank Ltd", 2), (3, "First Union Bank plc", 2)]
    inst = spark.createDataFrame([(i, n, c) for i, n, c in rows], "id long, display_name string, country_id int")
    links = spark.createDataFrame([(7, 2), (7, 3), (8, 1)], "bin_id long, institution_id long")
    pairs = {(r["a"], r["b"]): r["can_merge"] for r in pipeline.name_pairs(inst, links).collect()}
    assert pairs[2, 3] and not pairs[1, 2]
    assert [tuple(r) for r in pipeline.survivors(pipeline.name_pairs(inst, links)).collect()] == [(3, 2)]


def test_merge_keeps_one_key_with_very_many_rows(spark):
    df = spark.range(20000).selectExpr("0 as bin", "id as line", "cast(id % 3 as string) as network", "50.0 as confidence", "false as current")
    (r,) = pipeline.merge_fields(df, "bin", ["line"], ["network"]).collect()
    assert r["network"] == "0" and {(c["value_a"], c["value_b"]) for c in r["conflicts"]} == {("0", "1"), ("0", "2")}


def test_weak_blocks_of_any_size_on_demand(spark):
    inst = spark.createDataFrame([(i, f"Granite {chr(97 + i // 9)}{chr(97 + i % 9)} House", 1) for i in range(70)], "id long, display_name string, country_id int")
    links = spark.createDataFrame([], "bin_id long, institution_id long")
    assert pipeline.name_pairs(inst, links).count() == 273  # those that share an acronym
    assert pipeline.name_pairs(inst, links, weak_block=None).count() == 70 * 69 // 2
