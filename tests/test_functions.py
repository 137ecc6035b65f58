"""Scalar tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prefixlake.functions import cards, digits, display, geo, names, text


def values(spark, build, inputs, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
    return [r[0] for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


@pytest.mark.parametrize(
    ("build", "table"),
    [
        (text.squash, {"Société Générale": "societe generale", "A & B, Ltd.": "a and b ltd", " x\t y ": "x y", None: ""}),
        (text.strip_accents, {"Ångström ñ": "Angstrom n", "ＡＢ": "AB"}),
        (text.csv_safe, {"=1+1": "'=1+1", "-3": "-3", "+x": "'+x", "ok": "ok", None: ""}),
        (cards.network, {"VISA GOLD CREDIT": "visa", "Master Card": "mastercard", "": "unknown", "cb": "cartes_bancaires", "zzz": "unknown"}),
        (cards.card_type, {"Gift Card": "prepaid", "PREPAID GOLD": "prepaid", "deferred debit": "deferred_debit", "?": "unknown"}),
        (cards.status, {"not in use": "inactive", "LIVE": "active", "gone": "unknown"}),
        (cards.tri_state, {"Yes": True, "retail": False, "perhaps": None, None: None}),
        (cards.card_level, {"GOLD ATM": "Gold ATM", "prepaid  classic": "Prepaid Classic"}),
        (cards.currency, {"usd": "USD", "u.s.d": "USD", "euro": None}),
        (digits.scheme_of, {"622126": None, "622125": "unionpay", "4111": "visa", "180012": None, "352800": "jcb", "9": None}),
        (digits.luhn_ok, {"4539578763621486": True, "79927398713": True, "79927398710": False}),
        (geo.title, {"new york": "New York", "PORTO DE  MAR": "Porto de MAR", "NYC": "NYC"}),
        (names.host, {"https://www.Bank.com/x": "bank.com", "bank.com": "bank.com", None: None}),
        (display.bin_groups, {"414720": "414720", "41472012": "4147 2012", "41472012345": "4147 2012 345"}),
        (display.duration, {"45": "45s", "200": "3m 20s", "3900": "1h 05m"}),
    ],
)
def test_table(spark, build, table):
    assert values(spark, build, list(table)) == list(table.values())


def test_list_prefix_never_repeats_a_card_number(spark):
    got = values(spark, digits.list_prefix, ["414720", "41472", "4111111111111111", "4.1E+11", "abc", ""])
    assert [tuple(r) for r in got] == [("414720", None), (None, "too short"), (None, "too long"), (None, "scientific notation"), (None, "not digits"), (None, "blank")]
    assert [r["value"] for r in values(spark, lambda c: digits.list_prefix(c, True), ["4147", "4147201"])] == ["004147", "04147201"]


def test_names(spark):
    df = spark.createDataFrame([("CSCBANK S.A.L.",), ("Northshore CU",), ("JPMorgan Chase Bank, N.A.",), ("Holdings Group",)], "v string").select(names.name_struct(F.col("v")).alias("n"))
    assert [(r["n"]["normalized"], r["n"]["core"]) for r in df.collect()] == [
        ("cscbank sal", "cscbank sal"),
        ("northshore credit union", "northshore credit union"),
        ("jpmorgan chase bank na", "jpmorgan chase bank"),
        ("holdings group", "holdings"),
    ]


def test_similarity(spark):
    pairs = [("First Bank Ltd", "First Bank"), ("Alpha Trust", "Omega Savings"), ("JPMorgan Chase", "JPMorgan Chase Bank")]
    df = spark.createDataFrame(pairs, "a string, b string").select(names.name_struct(F.col("a")).alias("x"), names.name_struct(F.col("b")).alias("y"))
    df = df.withColumn("r", names.sequence_ratio("x.core", "y.core")).select(names.similarity(F.col("x"), F.col("y"), F.col("r")))
    a, b, c = (r[0] for r in df.collect())
    assert a == pytest.approx(0.97) and b < 0.4 and 0.7 < c < 0.97


def test_versions():
    assert [display.version_compare(a, b) for a, b in (("1.2", "1.10"), ("2.0", "2"), ("1.0-b", "1.0-a"))] == [-1, 0, 1]


def test_countries(spark):
    land = spark.createDataFrame([("US", "USA", "840", "United States"), ("KR", "KOR", "410", "Korea, Republic of"), ("GB", "GBR", "826", "United Kingdom")], "iso2 string, iso3 string, numeric_code string, name string")
    raw = spark.createDataFrame([(x,) for x in ("us", "kor", "826", "England", "korea", "united", "nowhere")], "raw string")
    got = {r["raw"]: r["iso2"] for r in geo.resolve_countries(raw, "raw", land).collect()}
    assert got == {"us": "US", "kor": "KR", "826": "GB", "England": "GB", "korea": "KR", "united": None, "nowhere": None}
