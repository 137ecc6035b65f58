"""The resolver's rungs, merges with all that hangs on institutions, and the composed rebuild."""

from __future__ import annotations

import pytest

from prefixlake.operators import institutions, rebuild
from prefixlake.sources.release import Releases

KNOWN = "id long, display_name string, normalized_name string, normalized_legal_name string, country_id int, website string, swift_bic string"


@pytest.fixture(scope="module")
def known(spark):
    rows = [
        (1, "First Bank", "first bank", "first bank holding corp", 1, "https://www.first.example", "FIRSUS33"),
        (2, "First Bank", "first bank", None, 2, None, None),
        (3, "Northwind Credit Union", "northwind credit union", None, 1, "northwind.example", None),
        (4, "Twin Trust", "twin trust", None, 1, None, None),
        (5, "Twin Trust", "twin trust", None, 1, None, None),
    ]
    return spark.createDataFrame(rows, KNOWN)


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([(3, "nwcu"), (4, "double"), (5, "double")], "institution_id long, normalized_alias string")


@pytest.mark.parametrize(
    ("ask", "want"),
    [
        ({"issuer": "Somebody Else", "legal_name": "First Bank Holding Corp"}, ("exact", 1, 0.99)),
        ({"issuer": "First Bank", "country_id": 2}, ("canonical", 2, 0.96)),
        ({"issuer": "FIRST  BANK"}, ("conflict", None, 0.0)),
        ({"issuer": "Twin Trust", "country_id": 1}, ("conflict", None, 0.0)),
        ({"issuer": "NWCU"}, ("alias", 3, 0.93)),
        ({"issuer": "Double"}, ("unknown", None, 0.0)),
        ({"issuer": "Northwind Credit Union Ltd", "country_id": 1, "website": "https://northwind.example/about"}, ("strong", 3, None)),
        ({"issuer": "Northwind Credit Unions"}, ("possible", None, None)),
        ({"issuer": "Qqqq"}, ("unknown", None, 0.0)),
        ({"issuer": None}, ("unknown", None, 0.0)),
    ],
)
def test_each_rung(spark, known, aliases, ask, want):
    fields = ["issuer", "legal_name", "country_id", "website"]
    raw = spark.createDataFrame([tuple(ask.get(f) for f in fields)] * 2, "issuer string, legal_name string, country_id int, website string")
    got = institutions.resolve_names(raw, known, aliases).collect()
    assert len(got) == 2  # repeated questions keep their rows
    assert (got[0]["match_type"], got[0]["institution_id"]) == want[:2]
    assert want[2] is None or got[0]["confidence"] == want[2]


def test_merge_moves_everything(spark):
    inst = spark.createDataFrame([(1, "North Bank", None, None, 2), (2, "North Bk", "a.example", 7, None), (3, "N. Bank", "b.example", None, None), (9, "Child", None, None, 3)], "id long, display_name string, website string, country_id int, parent_id long")
    survivors = spark.createDataFrame([(2, 1), (3, 1)], "old long, kept long")
    links = spark.createDataFrame([(5, 1, "issuer", 10), (5, 2, "issuer", 20), (6, 3, "issuer", 30)], "bin_id long, institution_id long, relationship_type string, line long")
    aliases = spark.createDataFrame([(2, "NB", "nb", "listed", 0.5), (3, "Nb", "nb", "listed", 0.6)], "institution_id long, alias string, normalized_alias string, alias_type string, confidence double")
    addresses = spark.createDataFrame([(1, 1, "x", True), (2, 2, "x", True), (3, 3, "y", True)], "id long, institution_id long, fingerprint string, is_primary boolean")
    done = {k: v.collect() for k, v in institutions.merge_institutions(inst, survivors, links, aliases, addresses, ["line"]).items()}
    assert sorted(map(tuple, done["institutions"]), key=str) == sorted([(1, "North Bank", "a.example", 7, None), (9, "Child", None, None, 1)], key=str)
    assert [tuple(r) for r in done["conflicts"]] == [(1, "website", "a.example", "b.example")]
    assert sorted(map(tuple, done["links"])) == [(5, 1, "issuer", 10), (6, 1, "issuer", 30)]
    assert sorted((r["institution_id"], r["normalized_alias"], r["alias"]) for r in done["aliases"]) == [(1, "n bank", "N. Bank"), (1, "nb", "NB"), (1, "north bank", "North Bk")]
    assert sorted(map(tuple, done["addresses"])) == [(1, 1, "x", True), (3, 1, "y", False)]


def test_rebuild_refuses_to_shrink(spark, tmp_path):
    lands = spark.createDataFrame([(1, "AX", "AUR")], "id int, iso2 string, currency_code string")
    shape = "line long, bin string, issuer string, iso2 string, relationship string, effective_from timestamp, effective_to timestamp, confidence double, network string, country_id string, card_type string, funding_type string, status string"
    rows = [(i, str(400000 + i), f"Bank {i % 3}", "AX", "issuer", None, None, 0.8, "visa", None, "credit", "credit", "active") for i in range(12)]
    held = Releases(spark, f"file://{tmp_path}/releases")
    manifest = {r["table"]: r["rows"] for r in rebuild.rebuild(held, "1", "2024-01-01", spark.createDataFrame(rows, shape), lands).collect()}
    assert (manifest["bins"], manifest["institutions"], manifest["links"], manifest["staging"]) == (12, 3, 12, 12)
    bins = held.table("bins")
    assert {(r["country_id"], r["currency"]) for r in bins.select("country_id", "currency").collect()} == {(1, "AUR")}
    with pytest.raises(ValueError, match="not published"):
        rebuild.rebuild(held, "2", "2024-02-01", spark.createDataFrame(rows[:3], shape), lands)
    assert held.live() == "1"
