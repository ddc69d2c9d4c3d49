"""Validators of the detector and of invoice rules: stricter or laxer than the others, as plain booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.validators import compact, digits_of, mod97, weighted_sum

# IBAN lengths by country, for all countries that the detector takes.
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22,
    "VG": 24, "XK": 20,
}
# Words that no person's name holds here, and boxes that are no streets.
COMMON = (
    "fondation", "collective", "case", "postale", "notre", "votre", "zurich", "suisse", "switzerland", "scanning", "assurances", "chemin", "route", "rue", "avenue", "visiteurs", "direct", "technologies", "softcom", "vita", "mesdames", "messieurs",
)
BOXES = ("case postale", "postfach", "p.o. box", "boîte postale")
# What stands before product codes that look like phone numbers.
PRODUCT = r"(?i)(?:art|ref|réf|sku|ean|isbn|model|modell|serial|code|no|nr)[.:]?[ ]*$"


def iban(text: Column) -> Column:
    """A known country with its length, and remainder 1 by 97."""
    code = F.replace(compact(text), F.lit("-"), F.lit(""))
    length = F.create_map(*[F.lit(x) for kv in LENGTHS.items() for x in kv])[F.substring(code, 1, 2)]
    return F.coalesce((F.length(code) == length) & code.rlike("^[A-Z0-9]+$") & (mod97(code) == 1), F.lit(False))


def invoice_iban(text: Column) -> Column:
    """15 to 34 characters after two letters, and remainder 1 by 97, of any country."""
    code = compact(text)
    return F.length(code).between(15, 34) & code.rlike("^[A-Z]{2}[A-Z0-9]+$") & (mod97(code) == 1)


def avs(text: Column) -> Column:
    """Thirteen digits from 756 with their check digit."""
    d = digits_of(text)
    return F.coalesce((F.length(d) == 13) & d.startswith("756") & (F.substring(d, 13, 1).try_cast("int") == F.pmod(10 - F.pmod(weighted_sum(d, [1, 3] * 6), F.lit(10)), F.lit(10))), F.lit(False))


def street(text: Column) -> Column:
    """A name of five letters or more before a number, and no box."""
    name = F.btrim(F.regexp_replace(text, r"\s+\d+[A-Za-z]?\s*$", ""))
    box = F.lit(False)
    for b in BOXES:
        box = box | F.contains(F.lower(text), F.lit(b))
    return (F.length(text) >= 5) & text.rlike(r"\d+[A-Za-z]?\s*$") & (F.length(name) >= 5) & ~box


def person(text: Column) -> Column:
    """Two words or more, none of them common here or an acronym of three letters or more."""
    parts = F.split(F.btrim(text), r"\s+")
    return (F.length(text) >= 3) & (F.size(parts) >= 2) & F.forall(parts, lambda p: ~F.lower(p).isin(*COMMON) & ~((p == F.upper(p)) & (F.length(p) > 2)))


def date(text: Column) -> Column:
    """Day, month and year, each in its range; the day isn't held against the month."""
    p = F.split(text, r"\.")
    n = lambda i: F.get(p, i).try_cast("int")
    return F.coalesce((F.size(p) == 3) & n(0).between(1, 31) & n(1).between(1, 12) & n(2).between(1900, 2100), F.lit(False))


#: By pattern of the detector; patterns without one need none.
OF_PATTERN = {"iban": iban, "iban_formatted": iban, "avs": avs, "avs_nodots": avs, "date": date, "street": street, "person_tel": person, "person_ref": person, "person_sig": person}
