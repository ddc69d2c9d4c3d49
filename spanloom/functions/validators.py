"""Validators of identifiers: each gives a struct (valid, confidence) of a string column, natively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.regex import spark_regex

# The confidence ladder.
CHECKSUM_VALID, FORMAT_VALID, STANDARD, KNOWN_VALID, MODERATE, WEAK = 0.95, 0.9, 0.85, 0.82, 0.75, 0.5
INVALID_FORMAT, FAILED, FALSE_POSITIVE = 0.4, 0.3, 0.2

# IBAN lengths by country.
IBAN_LENGTHS = {
    "CH": 21, "LI": 21, "DE": 22, "AT": 20, "FR": 27, "IT": 27, "ES": 24, "NL": 18, "BE": 16, "LU": 20, "GB": 22, "IE": 22, "PT": 25, "GR": 27, "PL": 28, "CZ": 24, "SK": 24, "HU": 28,
    "SE": 24, "DK": 18, "NO": 15, "FI": 18,
}

# Numbers of month names in English, German, French and Italian.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "januar": 1, "februar": 2, "märz": 3,
    "maerz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12, "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "juin": 6, "juillet": 7, "août": 8, "aout": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12, "gennaio": 1, "febbraio": 2, "marzo": 3, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "agosto": 8, "settembre": 9,
    "ottobre": 10, "dicembre": 12,
}

# Calling codes that phone numbers may start with, and Swiss mobile prefixes.
CALLING_CODES = ("41", "49", "33", "39", "43", "32", "31", "352")
MOBILE = ("76", "77", "78", "79")

# Words that follow a year but are no city, and Swiss cities whose postal code looks like a year.
NOT_CITIES = (
    "attestation", "rapport", "report", "bericht", "document", "dokument", "contrat", "contract", "vertrag", "contratto", "version", "edition", "ausgabe", "edizione", "année", "annee", "year", "jahr",
    "anno", "execution", "exécution", "ausführung", "esecuzione", "pour", "and", "oder", "from", "with", "date", "depuis", "since", "ab", "fondation", "collective", "stiftung", "fondazione", "l'exécution",
    "l'execution", "l'année", "l'annee",
)
YEAR_CITIES = (
    "sion", "sierre", "martigny", "monthey", "saxon", "fully", "leytron", "chamoson", "conthey", "vétroz", "vetroz", "ardon", "riddes", "saillon", "brig", "visp", "naters", "zermatt", "saas-fee",
    "neuchâtel", "neuchatel", "la chaux-de-fonds", "le locle", "fleurier", "couvet", "môtiers", "motiers", "travers", "boudry", "cortaillod", "colombier", "auvernier", "bevaix", "gorgier", "saint-aubin",
)

# An e-mail address.
EMAIL = r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+$"


def _is(valid: Column | bool, confidence: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(valid).alias("valid"), as_column(confidence).cast("double").alias("confidence"))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def weighted_sum(digits: Column, weights: list[int]) -> Column:
    """The sum of the first digits times weights."""
    return sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def swiss_avs(text: Column) -> Column:
    """Swiss social security number: thirteen digits from 756 with an EAN-13 check digit; at most 20 characters."""
    d = digits_of(text)
    check = F.pmod(10 - F.pmod(weighted_sum(d, [1, 3] * 6), F.lit(10)), F.lit(10))
    return (
        F.when(F.length(text) > 20, _is(False, FAILED))
        .when(F.length(d) != 13, _is(False, INVALID_FORMAT))
        .when(~d.startswith("756"), _is(False, INVALID_FORMAT))
        .when(F.substring(d, 13, 1).try_cast("int") == check, _is(True, CHECKSUM_VALID))
        .otherwise(_is(False, FAILED))
    )


def mod97(code: Column) -> Column:
    """The remainder by 97 of a code whose first four characters are moved to its end and whose letters are numbers from 10."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        return F.when(v >= 65, F.pmod(acc * 100 + v - 55, F.lit(97))).otherwise(F.pmod(acc * 10 + v - 48, F.lit(97)))

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def compact(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, spark_regex(r"\s"), ""))


def iban(text: Column) -> Column:
    """IBAN of at most 34 characters: length by country, where known, and remainder 1 by 97."""
    code = compact(text)
    length = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])[F.substring(code, 1, 2)]
    return (
        F.when(F.length(text) > 34, _is(False, FAILED))
        .when(F.length(code) < 15, _is(False, FAILED))
        .when(length.isNotNull() & (F.length(code) != length), _is(False, INVALID_FORMAT))
        .when(code.rlike("^[A-Z0-9]+$") & (mod97(code) == 1), _is(True, CHECKSUM_VALID))
        .otherwise(_is(False, INVALID_FORMAT))
    )


def email(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(F.length(text) > 254, _is(False, FAILED))
        .when(~low.rlike(EMAIL), _is(False, FAILED))
        .when(F.contains(low, F.lit("..")), _is(False, FAILED))
        .when(F.length(F.element_at(F.split(low, r"\."), -1)) < 2, _is(False, INVALID_FORMAT))
        .otherwise(_is(True, FORMAT_VALID))
    )


def phone(text: Column) -> Column:
    """Nine to fifteen digits with a known calling code or a local zero; Swiss mobiles are surer."""
    d = digits_of(text)
    known = d.rlike(f"^(?:00)?(?:{'|'.join(CALLING_CODES)})")
    local = d.rlike("^0(?!0)") | (d == "0")
    mobile = d.rlike(f"^(?:41|0(?!0))(?:{'|'.join(MOBILE)})")
    return (
        F.when(F.length(text) > 20, _is(False, FAILED))
        .when((F.length(d) < 9) | (F.length(d) > 15), _is(False, FAILED))
        .when(~known & ~local, _is(False, WEAK))
        .otherwise(_is(True, F.when(mobile, FORMAT_VALID).otherwise(MODERATE)))
    )


def parsed_date(text: Column) -> Column:
    """(day, month, year) of a numeric date or one with a month's name; two-digit years over 30 are of the last century."""
    numeric, named = r"(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})", r"(\d{1,2})\.?" + spark_regex(r"\s*") + r"([a-zäöüéè]+)" + spark_regex(r"\s*") + r"(\d{2,4})"
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    low = F.lower(text)
    of = lambda t, p, i: F.regexp_extract(t, p, i).try_cast("int")
    year = lambda y: F.when(y >= 100, y).when(y > 30, y + 1900).otherwise(y + 2000)
    made = lambda d, m, y: F.struct(d.alias("day"), m.alias("month"), year(y).alias("year"))
    month = months[F.regexp_extract(low, named, 2)]
    return F.when(text.rlike(numeric), made(of(text, numeric, 1), of(text, numeric, 2), of(text, numeric, 3))).when(low.rlike(named) & month.isNotNull(), made(of(low, named, 1), month, of(low, named, 3)))


def date(text: Column) -> Column:
    d = parsed_date(text)
    last = F.day(F.last_day(F.make_date(d["year"], F.greatest(F.lit(1), F.least(F.lit(12), d["month"])), F.lit(1))))
    return (
        F.when(F.length(text) > 50, _is(False, FAILED))
        .when(d.isNull(), _is(False, INVALID_FORMAT))
        .when((d["month"] < 1) | (d["month"] > 12), _is(False, FAILED))
        .when((d["day"] < 1) | (d["day"] > last), _is(False, FAILED))
        .when((d["year"] < 1900) | (d["year"] > 2100), _is(False, INVALID_FORMAT))
        .otherwise(_is(True, STANDARD))
    )


def vat(text: Column) -> Column:
    """Swiss UID with a check digit by 11, or a German, French, Italian or Austrian number by its form."""
    up, d = F.upper(text), digits_of(text)
    check = 11 - F.pmod(weighted_sum(d, [5, 4, 3, 2, 7, 6, 5, 4]), F.lit(11))
    good = F.substring(d, 9, 1).try_cast("int") == F.when(check == 11, 0).otherwise(check)
    swiss = F.when(F.length(d) != 9, _is(False, INVALID_FORMAT)).when(good, _is(True, FORMAT_VALID)).otherwise(_is(False, WEAK))
    return F.when(F.length(text) > 20, _is(False, FAILED)).when(up.startswith("CHE"), swiss).when(compact(text).rlike(r"^(DE|FR|IT|AT)\d{8,11}$"), _is(True, MODERATE)).otherwise(_is(False, INVALID_FORMAT))


def swiss_address(text: Column) -> Column:
    """Postal code and city, without any text around it: a code that may be a year needs a known city, or no word that follows years."""
    code = F.substring(text, 1, 4).try_cast("int")
    city = F.btrim(F.substring(text, 5, 10_000))
    first = F.lower(F.split(city, spark_regex(r"\s"))[0])
    year = code.between(1900, 2099)
    return (
        F.when(text.rlike(spark_regex(r"\bwww\b|\.ch\b|\.com\b|http", fold=True)), _is(False, FAILED))
        .when(code.isNull() | (code < 1000) | (code > 9999), _is(False, FAILED))
        .when(F.length(city) < 3, _is(False, FAILED))
        .when(year & first.isin(*YEAR_CITIES), _is(True, KNOWN_VALID))
        .when(year & first.isin(*MONTHS), _is(False, FALSE_POSITIVE))
        .when(year & first.isin(*NOT_CITIES), _is(False, FAILED))
        .when(first.isin(*NOT_CITIES), _is(False, INVALID_FORMAT))
        .otherwise(_is(True, KNOWN_VALID))
    )


def postal_code(text: Column) -> Column:
    """A Swiss postal code, with or without CH-: 1000 to 9699."""
    clean = F.regexp_replace(F.upper(text), r"^CH[-\s]?", "")
    code = F.regexp_replace(clean, r"\s", "")
    value = code.try_cast("int")
    return F.when(~code.rlike("^[0-9]{4}$"), _is(False, INVALID_FORMAT)).when(value.between(1000, 9699), _is(True, STANDARD)).otherwise(_is(False, WEAK))


#: The validator of each type of entity; types without one stay unchecked.
VALIDATORS = {"SWISS_AVS": swiss_avs, "IBAN": iban, "EMAIL": email, "PHONE": phone, "DATE": date, "VAT_NUMBER": vat, "SWISS_ADDRESS": swiss_address}


class ValidatorRegistry:
    """Validators by type; one takes the place of another only with a higher priority, and none after freeze()."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Callable[[Column], Column], int]] = {}
        self._frozen = False

    def register(self, kind: str, validator: Callable[[Column], Column], priority: int = 0) -> bool:
        if self._frozen:
            raise RuntimeError(f"the registry is frozen; {kind} can't be registered")
        if kind in self._known and priority <= self._known[kind][1]:
            return False
        self._known[kind] = (validator, priority)
        return True

    def get(self, kind: str) -> Callable[[Column], Column] | None:
        return self._known.get(kind, (None, 0))[0]

    def freeze(self) -> None:
        self._frozen = True

    def check(self, kind: Column, text: Column) -> Column:
        """(valid, confidence) of the type's validator; null for types without one."""
        out = F.lit(None)
        for name, (validator, _) in self._known.items():
            out = F.when(kind == name, validator(text)).otherwise(out)
        return out

    def __contains__(self, kind: str) -> bool:
        return kind in self._known

    def __len__(self) -> int:
        return len(self._known)
