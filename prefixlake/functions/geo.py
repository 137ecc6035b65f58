"""Countries, regions, places and postal codes (F13-F17). The table of countries is a parameter, not a constant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.functions.text import collapse, squash, strip_accents

# Informal and former country names.
COUNTRY_ALIASES = {
    "USA": "US", "U S A": "US", "U S": "US", "UNITED STATES OF AMERICA": "US", "AMERICA": "US", "UK": "GB", "U K": "GB", "GREAT BRITAIN": "GB", "ENGLAND": "GB", "SCOTLAND": "GB", "WALES": "GB",
    "NORTHERN IRELAND": "GB", "BRITAIN": "GB", "SOUTH KOREA": "KR", "REPUBLIC OF KOREA": "KR", "NORTH KOREA": "KP", "RUSSIA": "RU", "IVORY COAST": "CI", "COTE DIVOIRE": "CI", "CAPE VERDE": "CV",
    "CZECH REPUBLIC": "CZ", "SWAZILAND": "SZ", "BURMA": "MM", "HOLLAND": "NL", "THE NETHERLANDS": "NL", "UAE": "AE", "U A E": "AE", "VATICAN": "VA", "VATICAN CITY": "VA", "TURKEY": "TR",
    "MACEDONIA": "MK", "VIETNAM": "VN", "LAOS": "LA", "SYRIA": "SY", "BRUNEI": "BN", "PALESTINE": "PS", "TAIWAN PROVINCE OF CHINA": "TW", "HONG KONG SAR": "HK", "MACAU": "MO", "DRC": "CD",
    "CONGO KINSHASA": "CD", "CONGO BRAZZAVILLE": "CG", "DEUTSCHLAND": "DE", "ESPANA": "ES", "ITALIA": "IT", "NIPPON": "JP", "NIHON": "JP", "BRASIL": "BR", "MEXICO": "MX", "SUISSE": "CH",
    "SCHWEIZ": "CH", "SVIZZERA": "CH", "SVERIGE": "SE", "NORGE": "NO", "DANMARK": "DK", "SUOMI": "FI", "NEDERLAND": "NL", "OSTERREICH": "AT", "POLSKA": "PL", "CESKA REPUBLIKA": "CZ",
    "CESKO": "CZ", "MAGYARORSZAG": "HU", "ELLADA": "GR", "HELLAS": "GR", "PORTUGAL": "PT", "EIRE": "IE",
    "BOLIVIA PLURINATIONAL STATE OF": "BO", "MOLDOVA REPUBLIC OF": "MD", "TANZANIA UNITED REPUBLIC OF": "TZ", "MICRONESIA FEDERATED STATES OF": "FM",
}
# Words that stay small inside a place's name.
PARTICLES = ("of", "the", "de", "del", "la", "le", "du", "van", "der", "am", "an")
# Postal formats, as a pattern over letters and digits and its layout.
POSTAL_FORMATS = {
    "US": (r"^([0-9]{5})([0-9]{4})?$", "$1-$2"),
    "CA": (r"^([A-Z][0-9][A-Z])([0-9][A-Z][0-9])$", "$1 $2"),
    "GB": (r"^([A-Z]{1,2}[0-9][A-Z0-9]?)([0-9][A-Z]{2})$", "$1 $2"),
    "NL": (r"^([0-9]{4})([A-Z]{2})$", "$1 $2"),
    "PL": (r"^([0-9]{2})([0-9]{3})$", "$1-$2"),
    "JP": (r"^([0-9]{3})([0-9]{4})$", "$1-$2"),
    "BR": (r"^([0-9]{5})([0-9]{3})$", "$1-$2"),
    "PT": (r"^([0-9]{4})([0-9]{3})$", "$1-$2"),
}
# Subdivisions by ISO 3166-2 code, of the countries whose addresses name them by code.
SUBDIVISIONS = {
    "US": {
        "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia",
        "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine",
        "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
        "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
        "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
        "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "PR": "Puerto Rico", "VI": "U.S. Virgin Islands", "GU": "Guam", "AS": "American Samoa",
        "MP": "Northern Mariana Islands",
    },
    "CA": {
        "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories",
        "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
    },
    "AU": {
        "ACT": "Australian Capital Territory", "NSW": "New South Wales", "NT": "Northern Territory", "QLD": "Queensland", "SA": "South Australia", "TAS": "Tasmania", "VIC": "Victoria",
        "WA": "Western Australia",
    },
}


def subdivisions(spark: SparkSession) -> DataFrame:
    """(country, code, name): the known subdivisions as a dimension."""
    return spark.createDataFrame([(land, code, name) for land, table in SUBDIVISIONS.items() for code, name in table.items()], "country string, code string, name string")


def resolve_countries(values: DataFrame, column: str, countries: DataFrame) -> DataFrame:
    """``values`` with ``iso2`` of the free-text ``column``.

    ``countries`` has iso2 and name, and iso3 and numeric_code where known. Codes are tried first, then
    aliases, then the name, then a prefix of at least four characters that fits one name only. Every
    rung is the same equi-join, on (rung, key); prefixes meet on their first four characters. Distinct
    values are resolved once and joined back.
    """
    names = countries.columns
    distinct = values.select(column).distinct().where(F.col(column).isNotNull())
    upper = F.upper(F.trim(column))
    keyed = distinct.select(column, upper.alias("_u"), collapse(F.regexp_replace(strip_accents(upper), "[^A-Z0-9]", " ")).alias("_a"), squash(F.col(column)).alias("_s"))
    alias = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    keyed = keyed.withColumn("_alias", F.coalesce(F.try_element_at(alias, F.col("_a")), F.try_element_at(alias, F.replace(F.col("_a"), F.lit(" "), F.lit("")))))

    def rungs(*keys: Column | None) -> Column:
        every = [F.struct(F.lit(rung).alias("rung"), key.alias("key")) for rung, key in enumerate(keys) if key is not None]
        return F.explode(F.filter(F.array(*every), lambda x: x["key"].isNotNull())).alias("_k")

    number = F.when(F.col("_u").rlike("^[0-9]{1,3}$"), F.lpad("_u", 3, "0"))
    asked = keyed.select(column, "_s", rungs(F.col("_u"), F.col("_u"), number, F.col("_alias"), F.col("_s"), F.when(F.length("_s") >= 4, F.substring("_s", 1, 4))))
    name = squash(F.col("name"))
    land = countries.select(
        "iso2",
        name.alias("_name"),
        rungs(F.col("iso2"), F.col("iso3") if "iso3" in names else None, F.col("numeric_code") if "numeric_code" in names else None, F.col("iso2"), name, F.substring(name, 1, 4)),
    )
    land = land.select("iso2", "_name", F.col("_k").alias("_l"))
    pairs = asked.join(land, (F.col("_k.rung") == F.col("_l.rung")) & (F.col("_k.key") == F.col("_l.key"))).where((F.col("_k.rung") < 5) | F.col("_name").startswith(F.col("_s")))
    rung = F.col("_k.rung")
    best = pairs.groupBy(column).agg(F.min(rung).alias("_r"), F.min_by("iso2", F.struct(rung, "iso2")).alias("iso2"), F.countDistinct(F.when(rung == 5, F.col("iso2"))).alias("_n"))
    best = best.where((F.col("_r") < 5) | (F.col("_n") == 1)).select(F.col(column).alias("_value"), "iso2")
    return values.join(best, values[column] == best["_value"], "left").drop("_value")


def title(c: Column) -> Column:
    """Place names in title case; particles small, short capitals kept (F16)."""
    words = F.split(collapse(c), " ")

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return (
            F.when((i > 0) & low.isin(*PARTICLES), low)
            .when((F.length(w) <= 3) & (F.upper(w) == w) & (low != w), w)
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
        )

    return F.array_join(F.transform(words, one), " ")


def region(c: Column, country: Column | None = None) -> Column:
    """struct(code, name): the subdivision that a code or a name means in ``country`` (iso2), else the words as they are.

    Names are compared without accents and in capitals. Blank text has neither code nor name.
    """
    raw = F.nullif(collapse(c), F.lit(""))
    own = F.struct(F.when(F.length(raw) <= 3, F.upper(raw)).alias("code"), title(raw).alias("name"))
    if country is not None:
        names = F.create_map(*[F.lit(x) for land, table in SUBDIVISIONS.items() for code, name in table.items() for x in (f"{land} {code}", name)])
        codes = F.create_map(*[F.lit(x) for land, table in SUBDIVISIONS.items() for code, name in table.items() for x in (f"{land} {name.upper()}", code)])
        said = F.concat(F.upper(country), F.lit(" "), F.upper(raw))
        code = F.coalesce(F.when(F.try_element_at(names, said).isNotNull(), F.upper(raw)), F.try_element_at(codes, F.concat(F.upper(country), F.lit(" "), strip_accents(F.upper(raw)))))
        name = F.try_element_at(names, F.concat(F.upper(country), F.lit(" "), code))
        own = F.when(code.isNotNull(), F.struct(code.alias("code"), name.alias("name"))).otherwise(own)
    return F.when(raw.isNotNull(), own).otherwise(F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("name")))


def normalized_postal(c: Column) -> Column:
    """Letters and digits only, upper case; nothing left is null."""
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def postal(c: Column, country: Column) -> Column:
    """The country's layout where the code fits it, else letters and digits."""
    plain = normalized_postal(c)
    out = plain
    for iso2, (pattern, layout) in POSTAL_FORMATS.items():
        out = F.when((country == iso2) & plain.rlike(pattern), F.regexp_replace(F.regexp_replace(plain, pattern, layout), "[- ]+$", "")).otherwise(out)
    return out


def normalized_city(c: Column) -> Column:
    return F.nullif(squash(c), F.lit(""))
