"""Approved facts written, their provenance, and undoing them."""

from __future__ import annotations

import pytest

from prefixlake.operators import learning

FACT = "id long, subject_key string, field string, current_value string, proposed_value string, source_code string, confidence double, status string"


@pytest.fixture
def world(spark):
    bins = spark.createDataFrame([("400001", 1, None, "credit", None), ("400002", None, 2, "debit", "gold"), ("400003", 5, 5, None, None)], "bin string, network_id int, country_id int, card_type string, card_level string")
    meanings = spark.createDataFrame([("network", "Visa", 7), ("country", "FR", 33), ("country", "France", 33), ("country", "DE", 49)], "field string, name string, value int")
    facts = spark.createDataFrame(
        [
            (1, "400001", "country", "", "fr", "a", 0.6, "approved"),
            (2, "400001", "country", "", "DE ", "b", 0.9, "approved"),
            (3, "400001", "card_type", "credit", "debit", "a", 0.6, "pending"),
            (4, "400002", "network", "", "nobody", "a", 0.6, "approved"),
            (5, "400002", "network", "", "visa", "a", 0.6, "approved"),
            (6, "400002", "notes", "", "x", "a", 0.6, "approved"),
            (7, "999999", "country", "", "FR", "a", 0.6, "approved"),
            (8, "400003", "card_type", None, "charge", "a", 0.6, "approved"),
            (9, "400003", "brand", None, "x", "a", 0.6, "approved"),
        ],
        FACT,
    )
    return bins, facts, meanings


def rows(df):
    return {r["bin"]: tuple(r)[1:] for r in df.collect()}


def test_applied_with_provenance(world):
    table, ledger, provenance = learning.apply_approved(*world)
    assert rows(table) == {"400001": (1, 49, "credit", None), "400002": (7, 2, "debit", "gold"), "400003": (5, 5, "charge", None)}
    assert {r["id"]: r["status"] for r in ledger.collect()} == {1: "applied", 2: "applied", 3: "pending", 4: "approved", 5: "applied", 6: "approved", 7: "approved", 8: "applied", 9: "approved"}
    found = {r["fact_id"]: (r["replaced_value"], r["written_value"], r["in_force"], r["rule"]) for r in provenance.collect()}
    assert found == {1: (None, "33", False, "learned:a"), 2: (None, "49", True, "learned:b"), 5: (None, "7", True, "learned:a"), 8: (None, "charge", True, "learned:a")}
    assert table.columns == world[0].columns and ledger.columns == world[1].columns


def test_undone(world):
    table, ledger, provenance = learning.apply_approved(*world)
    back, facts = learning.undo(table, ledger, provenance)
    assert rows(back) == rows(world[0]) and {r["id"]: r["status"] for r in facts.collect()} == {r["id"]: r["status"] for r in world[1].collect()}
    later = table.replace({49: 33}, subset=["country_id"])  # written by somebody else since
    assert rows(learning.undo(later, ledger, provenance)[0])["400001"][1] == 33


def test_nothing_to_apply(world):
    bins, facts, meanings = world
    table, ledger, provenance = learning.apply_approved(bins, facts.where("status = 'pending'"), meanings)
    assert rows(table) == rows(bins) and provenance.count() == 0 and ledger.count() == 1
