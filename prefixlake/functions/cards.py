"""Card vocabulary as column expressions: networks, card and funding types, status, indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefixlake.functions.text import sanitise, squash

# Alias tables, in comparison form.
NETWORK_ALIASES = {
    "visa": "visa", "visa inc": "visa", "visa international": "visa", "visa credit": "visa", "visa debit": "visa", "visa electron": "visa", "vis": "visa", "v": "visa", "visa card": "visa",
    "mastercard": "mastercard", "master card": "mastercard", "mc": "mastercard", "mastercard worldwide": "mastercard", "mastercard international": "mastercard", "eurocard": "mastercard", "master": "mastercard", "mcw": "mastercard",
    "amex": "amex", "american express": "amex", "americanexpress": "amex", "ax": "amex", "amex card": "amex",
    "discover": "discover", "discover card": "discover", "disc": "discover", "discover financial services": "discover", "novus": "discover",
    "jcb": "jcb", "japan credit bureau": "jcb",
    "unionpay": "unionpay", "union pay": "unionpay", "china unionpay": "unionpay", "cup": "unionpay", "upi": "unionpay",
    "diners": "diners", "diners club": "diners", "diners club international": "diners", "dinersclub": "diners", "dci": "diners",
    "maestro": "maestro", "switch": "maestro", "maestro international": "maestro",
    "rupay": "rupay", "ru pay": "rupay", "mir": "mir", "nspk mir": "mir", "elo": "elo", "hipercard": "hipercard", "interac": "interac",
    "bancontact": "bancontact", "bancontact mistercash": "bancontact", "mister cash": "bancontact",
    "cartes bancaires": "cartes_bancaires", "cb": "cartes_bancaires", "carte bancaire": "cartes_bancaires",
    "dankort": "dankort", "troy": "troy", "verve": "verve", "bc card": "bc_card", "bccard": "bc_card", "napas": "napas",
    "uatp": "uatp", "universal air travel plan": "uatp",
    "private label": "private_label", "privatelabel": "private_label", "store card": "private_label", "own brand": "private_label",
}
NETWORK_NAMES = {
    "visa": "Visa", "mastercard": "Mastercard", "amex": "American Express", "discover": "Discover", "jcb": "JCB", "unionpay": "UnionPay", "diners": "Diners Club", "maestro": "Maestro",
    "rupay": "RuPay", "mir": "Mir", "elo": "Elo", "hipercard": "Hipercard", "interac": "Interac", "bancontact": "Bancontact", "cartes_bancaires": "Cartes Bancaires", "dankort": "Dankort",
    "troy": "Troy", "verve": "Verve", "bc_card": "BC Card", "napas": "NAPAS", "uatp": "UATP", "private_label": "Private Label", "unknown": "Unknown",
}
CARD_TYPES = {
    "credit": "credit", "credit card": "credit", "cr": "credit", "revolving": "credit", "revolving credit": "credit",
    "debit": "debit", "debit card": "debit", "dr": "debit", "check card": "debit", "cheque card": "debit", "immediate debit": "debit", "atm": "debit",
    "prepaid": "prepaid", "prepaid card": "prepaid", "stored value": "prepaid", "gift": "prepaid", "gift card": "prepaid", "reloadable": "prepaid", "payroll": "prepaid", "pre paid": "prepaid",
    "charge": "charge", "charge card": "charge", "deferred debit": "deferred_debit", "deferred": "deferred_debit",
}
FUNDING = {
    "credit": "credit", "debit": "debit", "prepaid": "prepaid", "pre paid": "prepaid", "charge": "charge", "stored value": "prepaid", "revolving": "credit", "immediate debit": "debit", "deferred debit": "credit",
}
FUNDING_OF_TYPE = {"credit": "credit", "debit": "debit", "prepaid": "prepaid", "charge": "charge", "deferred_debit": "credit"}
STATUSES = {
    "active": "active", "live": "active", "in use": "active", "current": "active", "valid": "active", "issued": "active",
    "inactive": "inactive", "dormant": "inactive", "suspended": "inactive", "not in use": "inactive",
    "retired": "retired", "withdrawn": "retired", "closed": "retired", "decommissioned": "retired", "expired": "retired",
    "reassigned": "reassigned", "transferred": "reassigned", "migrated": "reassigned",
}
TRUE_WORDS = ("1", "true", "t", "yes", "y", "commercial", "business", "corporate", "prepaid")
FALSE_WORDS = ("0", "false", "f", "no", "n", "consumer", "personal", "individual", "retail")
COMMERCIAL_HINTS = ("commercial", "business", "corporate", "corp card", "purchasing", "purchase", "fleet", "procurement", "b2b", "small business", "sme")
RELATIONSHIPS = ("issuer", "program_issuer", "former_issuer", "processor", "sponsor", "parent", "brand_owner", "unknown")


def _resolve(key: Column, table: dict[str, str], shortest: int = 1) -> Column:
    """Exact alias, else the longest alias that the key contains, earlier ones first among equals; else unknown.

    The key is bound to a variable, so that it is computed once however many aliases there are.
    """
    codes = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    parts = F.array(*[F.lit(a) for a in sorted(table, key=len, reverse=True) if len(a) >= shortest])

    def found(k: Column) -> Column:
        inside = F.try_element_at(codes, F.get(F.filter(parts, lambda a: k.contains(a)), F.lit(0)))
        return F.when(k == "", "unknown").otherwise(F.coalesce(F.try_element_at(codes, k), inside, F.lit("unknown")))

    return F.element_at(F.transform(F.array(key), found), 1)


def network(c: Column) -> Column:
    """Network code of a free-text scheme name."""
    return _resolve(squash(c), NETWORK_ALIASES, 3)


def card_type(c: Column) -> Column:
    """Card type of a free-text product."""
    return _resolve(squash(c), CARD_TYPES)


def funding_type(c: Column, kind: Column | None = None) -> Column:
    """Funding type, else what the card type says."""
    found = _resolve(squash(c), FUNDING)
    if kind is None:
        return found
    fallback = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FUNDING_OF_TYPE.items() for x in pair]), kind), F.lit("unknown"))
    return F.when(found != "unknown", found).otherwise(fallback)


def status(c: Column) -> Column:
    """Record status."""
    return _resolve(squash(c), STATUSES)


def tri_state(c: Column) -> Column:
    """True, false, or null where the words don't say."""
    key = squash(c.cast("string"))
    return F.when(key.isin(*TRUE_WORDS), True).when(key.isin(*FALSE_WORDS), False)


def is_prepaid(c: Column, kind: Column) -> Column:
    """The source's word, else true for prepaid cards."""
    return F.coalesce(tri_state(c), F.when(kind == "prepaid", True))


def is_commercial(c: Column, product: Column) -> Column:
    """The source's word, else true where the product hints at it."""
    key = squash(product)
    return F.coalesce(tri_state(c), F.when(F.lit(False) | key.rlike("|".join(COMMERCIAL_HINTS)), True))


def card_level(c: Column) -> Column:
    """A product tier with its shouting tidied, its words kept."""
    words = F.split(sanitise(c, 48), " ")
    tidy = F.transform(words, lambda w: F.when((F.length(w) <= 3) & (F.upper(w) == w) & (F.lower(w) != w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 48)))))
    return F.substring(F.array_join(tidy, " "), 1, 48)


def currency(c: Column) -> Column:
    """Three letters, upper case, else null."""
    code = F.regexp_replace(F.upper(F.trim(c)), r"(?U)[^\p{L}]", "")
    return F.when(F.length(code) == 3, code)


def brand_label(c: Column, code: Column) -> Column:
    """The source's brand, in the catalogue's spelling where it names the record's own network."""
    text = sanitise(c, 64)
    shown = F.try_element_at(F.create_map(*[F.lit(x) for pair in NETWORK_NAMES.items() for x in pair]), code)
    return F.when(text.isNull() | (network(text) == code), F.coalesce(shown, text)).otherwise(text)


def relationship(c: Column, effective_to: Column) -> Column:
    """The stated relationship, else former issuer where it has ended, else issuer."""
    stated = F.lower(F.trim(c))
    return F.when(stated.isin(*RELATIONSHIPS), stated).when(effective_to.isNotNull(), "former_issuer").otherwise("issuer")
