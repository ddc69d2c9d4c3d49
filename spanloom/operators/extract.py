"""Span extraction: pattern tables, and the scans that turn texts into rows of entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import spans, spans_sql


@dataclass(frozen=True)
class Pattern:
    """any_of: strings of which every match holds one; texts without them aren't searched."""

    type: str
    name: str
    regex: str
    fold: bool = False
    group: bool = False
    any_of: tuple[str, ...] = ()


# The high-recall patterns, in their order.
HIGH_RECALL = (
    Pattern("SWISS_AVS", "avs", r"756[.\s]?\d{4}[.\s]?\d{4}[.\s]?\d{2}", any_of=("756",)),
    Pattern("IBAN", "iban", r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{1,4}[ ]?){3,8}[A-Z0-9]{0,4}\b"),
    Pattern("EMAIL", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", any_of=("@",)),
    Pattern("PHONE", "phone", r"(?:\+|00)?(?:41|49|33|39|43)[\s.-]?(?:\(?\d{1,4}\)?[\s.-]?)?\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{2,4}"),
    Pattern("VAT_NUMBER", "vat_ch", r"\bCHE[-\s]?\d{3}[.\s]?\d{3}[.\s]?\d{3}(?:\s*(?:MWST|TVA|IVA))?\b", fold=True),
    Pattern("VAT_NUMBER", "vat_eu", r"\b(?:DE|FR|IT|AT)\s?\d{8,11}\b", any_of=("DE", "FR", "IT", "AT")),
    Pattern("PAYMENT_REF", "payment_ref", r"\b\d{2}[\s]?\d{5}[\s]?\d{5}[\s]?\d{5}[\s]?\d{5}[\s]?\d{5,6}\b"),
    Pattern("SWISS_ADDRESS", "address_ch", r"\b(?:CH[-\s]?)?[1-9]\d{3}[ \t]+[A-ZÄÖÜ][a-zäöüé]{2,}(?:-[A-Za-zäöüé]+){0,2}\b"),
    Pattern("EU_ADDRESS", "address_de", r"\b(?:D[-\s]?|A[-\s]?)?\d{5}[ \t]+[A-ZÄÖÜ][a-zäöüß]{2,}(?:-[A-Za-zäöüß]+){0,2}\b"),
    Pattern("EU_ADDRESS", "address_fr", r"\b(?:F[-\s]?)?\d{5}[ \t]+[A-ZÀÂÆÉÈÊËÏÎÔŒÙÛÜ][a-zàâæéèêëïîôœùûüÿç]{2,}(?:-[A-Za-zàâæéèêëïîôœùûüÿç]+){0,2}\b"),
    Pattern("ADDRESS", "street_de", r"\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse|weg|platz|allee)\s+\d+[a-z]?\b", fold=True),
    Pattern("ADDRESS", "street_fr", r"\b(?:rue|avenue|boulevard|chemin|place|allée)\s+(?:de\s+(?:la\s+)?|du\s+|des\s+)?[A-ZÀ-Ÿ][a-zà-ÿ]+(?:[\s-][A-Za-zà-ÿ]+)*\s+\d+[a-z]?\b", fold=True),
    Pattern("ADDRESS", "street_it", r"\b(?:via|viale|piazza|corso|vicolo|largo)\s+(?:del\s+|della\s+|dei\s+|delle\s+|di\s+)?[A-ZÀ-Ÿ][a-zà-ÿ]+(?:[\s-][A-Za-zà-ÿ]+)*\s+\d+[a-z]?\b", fold=True),
    Pattern("EU_ADDRESS", "address_it", r"\b(?:I[-\s]?)?\d{5}[ \t]+[A-ZÀÈÉÌÒÙ][a-zàèéìòù]{2,}(?:-[A-Za-zàèéìòù]+){0,2}\b"),
    Pattern("DATE", "date", r"\b(?:0?[1-9]|[12]\d|3[01])[\s./-](?:0?[1-9]|1[0-2])[\s./-](?:19|20)?\d{2}\b"),
    Pattern("DATE", "date_de", r"\b(?:0?[1-9]|[12]\d|3[01])\.?\s*(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s*(?:19|20)?\d{2,4}\b", fold=True),
    Pattern("DATE", "date_fr", r"\b(?:0?[1-9]|[12]\d|3[01])\s*(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)\s*(?:19|20)?\d{2,4}\b", fold=True),
    Pattern("ORGANIZATION", "organization", r"\b[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿA-Z]+(?:[\s-]+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿA-Z]+)*\s+(?:AG|SA|GmbH|Ltd|Inc|Corp|LLC|Sàrl|SARL|Cie|KG|SE|Plc)\.?\b", any_of=("AG", "SA", "GmbH", "Ltd", "Inc", "Corp", "LLC", "Sàrl", "SARL", "Cie", "KG", "SE", "Plc")),
    Pattern("ORGANIZATION", "acronym", r"\b[A-Z]{2,6}\s+(?:AG|SA|GmbH|Ltd|Inc|Corp|LLC|SE|Plc)\.?\b", any_of=("AG", "SA", "GmbH", "Ltd", "Inc", "Corp", "LLC", "SE", "Plc")),
    Pattern("PERSON_NAME", "person", r"\b[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]{2,}[ ]+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]{2,}\b"),
)

# The detector's patterns, in its order; the order is also its priority.
DETECTOR = (
    Pattern("IBAN", "iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}\b"),
    Pattern("IBAN", "iban_formatted", r"\b[A-Z]{2}[\s-]?[0-9]{2}(?:[\s-]?[A-Z0-9]{4}){2,7}(?:[\s-]?[A-Z0-9]{1,3})?\b"),
    Pattern("SWISS_AVS", "avs", r"\b756\.\d{4}\.\d{4}\.\d{2}\b", any_of=("756",)),
    Pattern("SWISS_AVS", "avs_nodots", r"\b756\d{10}\b", any_of=("756",)),
    Pattern("SWISS_AVS", "avs_masked", r"\b756\.(?:\d{4}|X{4}|\*{4})\.(?:\d{4}|X{4}|\*{4})\.(?:\d{2}|X{2}|\*{2})\b", fold=True),
    Pattern("SWISS_BANK_ACCOUNT", "bank_account", r"\b\d{2}-\d{5,6}-\d\b"),
    Pattern("EU_VAT", "eu_vat", r"\b(?:AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK)U?[0-9A-Z]{8,12}\b"),
    Pattern("SWISS_UID", "uid", r"\bCHE-\d{3}\.\d{3}\.\d{3}(?:\s+(?:MWST|TVA|IVA))?\b", any_of=("CHE-",)),
    Pattern("PASSPORT", "passport", r"\b[A-Z]\d{7}\b"),
    Pattern("LICENSE_PLATE", "plate", r"\b(?:AG|AI|AR|BE|BL|BS|FR|GE|GL|GR|JU|LU|NE|NW|OW|SG|SH|SO|SZ|TG|TI|UR|VD|VS|ZG|ZH)\s?\d{1,6}\b"),
    Pattern("PHONE", "phone", r"(?:\+41|0041|0)[\s-]?\(?\d{2}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}|(?:\+|00)\d{1,3}[\s-]?\(?\d{1,4}\)?[\s-]?\d{1,4}[\s-]?\d{1,4}(?:[\s-]?\d{1,4})?"),
    Pattern("PHONE", "phone_masked", r"(?:\+41|0041|0)[\s-]?\(?\d{2}\)?[\s-]?(?:\d{3}|X{3}|\*{3})[\s-]?(?:\d{2}|X{2}|\*{2})[\s-]?(?:\d{2}|X{2}|\*{2})", fold=True),
    Pattern("EMAIL", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", any_of=("@",)),
    Pattern("EMAIL", "email_multiline", r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*[A-Za-z0-9]\s*[\r\n]+\s*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", any_of=("@",)),
    Pattern("EMAIL", "email_masked", r"\b[A-Za-z0-9._%+-]*(?:\*{3,}|X{3,})[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", fold=True),
    Pattern("DATE", "date", r"\b(?:0?[1-9]|[12][0-9]|3[01])\.(?:0?[1-9]|1[012])\.(?:19|20)\d{2}\b"),
    Pattern("ADDRESS", "address", r"\b\d{4}[ \t]+[A-ZÀ-ÖØ-Ýa-zà-öø-ÿ][A-ZÀ-ÖØ-Ýa-zà-öø-ÿ\-']+(?:[ \t]+[A-ZÀ-ÖØ-Ýa-zà-öø-ÿ][A-ZÀ-ÖØ-Ýa-zà-öø-ÿ\-']+)?\b"),
    Pattern("ADDRESS", "street", r"\b(?:Rue|Route|Rte|Chemin|Ch\.|Avenue|Av\.|Boulevard|Bd|Allée|Place|Platz|Strasse|Str\.|Via|Viale|Corso|Piazza)(?:\s+(?:de\s+la|du|de|des|dell[ao']?|della|degli|dei))?\s+[A-ZÀ-ÖØ-Ýa-zà-öø-ÿ][A-ZÀ-ÖØ-Ýa-zà-öø-ÿ\s\-']{1,30}\s+\d{1,4}[A-Za-z]?\b", fold=True),
    Pattern("ORG", "company", r"\b[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-Ýà-öø-ÿ\s&\-']{2,}\s+(?:SA|GmbH|AG|Sàrl|SARL|Ltd|Inc|Corp|SAS|EURL)\b", any_of=("SA", "GmbH", "AG", "Sàrl", "SARL", "Ltd", "Inc", "Corp", "SAS", "EURL")),
    Pattern("ID_NUMBER", "id_number", r"\b\d{2,3}'?\d{3}'?\d{3}\b"),
    Pattern("PERSON_NAME", "person_tel", r"([A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+(?:\s+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+){1,3}),?\s*(?:[Tt][ée]l\.?|[Tt]éléphone)", group=True),
    Pattern("PERSON_NAME", "person_ref", r"(?:[Rr][ée]f[ée]rence|[Cc]ontact)\s+([A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+(?:\s+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+){1,3})", group=True),
    Pattern("PERSON_NAME", "person_sig", r"(?m)\b([A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+[ ]+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+)[ ]*$", group=True),
)

# Words that no person's name holds, endings of company names, and words that companies are called.
NOT_NAMES = (
    "source", "processed", "anonymised", "anonymized", "format", "model", "fondation", "collective", "case", "postale", "notre", "votre", "scanning", "assurances", "technologies", "visiteurs", "direct",
    "contact", "information", "details", "address", "email", "phone", "invoice", "number", "date", "due", "payment", "total", "amount", "description", "quantity", "price", "unit", "subtotal", "tax", "vat",
    "software", "module", "development", "project", "management", "services", "consulting", "support", "maintenance", "license", "subscription", "order", "reference", "customer", "client", "billing",
    "shipping", "zurich", "zürich", "geneve", "geneva", "bern", "basel", "lausanne", "suisse", "switzerland", "schweiz", "chemin", "route", "rue", "avenue", "strasse", "street", "place", "platz",
    "bahnhofstrasse", "hauptstrasse", "poststrasse", "dorfstrasse", "schulstrasse", "mesdames", "messieurs", "madame", "monsieur", "herr", "frau", "detection", "browser", "document", "markdown", "sample",
    "test", "via", "viale", "piazza", "corso", "vicolo", "largo", "allée", "boulevard", "gasse", "weg", "allee", "straße",
)
COMPANY_ENDS = (
    "ltd", "ag", "sa", "gmbh", "inc", "corp", "llc", "plc", "sàrl", "sarl", "cie", "kg", "ohg", "se", "nv", "bv", "holding", "group", "groupe", "gruppe", "technologies", "technologien", "services",
    "dienstleistungen", "solutions", "systems", "consulting", "partners", "associates", "foundation", "institute", "bank",
)

RULE_CONFIDENCE, LEAST_LENGTH = 0.7, 3


def is_person_name(text: Column) -> Column:
    """At least two words and five characters, each word a capital and small letters, none of them a word that names don't hold."""
    parts = F.split(F.btrim(text), r"\s+")
    low = F.transform(parts, lambda p: F.lower(p))
    last = F.regexp_replace(F.element_at(low, -1), r"\.$", "")
    shaped = F.forall(parts, lambda p: p.rlike("^[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+$"))
    known = F.forall(low, lambda p: ~p.isin(*NOT_NAMES))
    return (F.length(text) >= 5) & (F.size(parts) >= 2) & ~last.isin(*COMPANY_ENDS) & known & shaped


def is_person_name_sql(text: str) -> str:
    listed = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    parts = f"regexp_split_to_array(trim({text}), '\\s+')"
    return f"""(length({text}) >= 5 and len({parts}) >= 2 and not regexp_replace(lower({parts}[-1]), '\\.$', '') in ({listed(COMPANY_ENDS)})
  and len(list_filter({parts}, lambda p: lower(p) in ({listed(NOT_NAMES)}) or not regexp_full_match(p, '[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ]+'))) = 0)"""


ENTITY = "array<struct<start:int,end:int,text:string,type:string,pattern:string,rank:int>>"


def extract(docs: DataFrame, patterns: tuple[Pattern, ...], id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, type, pattern, rank, start, end, text) of all patterns' spans of least characters or more; one pass over the texts, without a shuffle.

    keep: further columns of docs, which come after them, so that a span meets its own text without a join.
    """
    found = [_named(spans(F.col(text_col), p.regex, p.fold, p.group, p.any_of), p, i) for i, p in enumerate(patterns)]
    # outer, since the planner would filter by the size of an inner generator's array, and so scan every text twice
    rows = docs.select(id_col, *keep, F.explode_outer(F.flatten(F.array_compact(F.array(*found)))).alias("e")).where("e is not null").select(id_col, "e.type", "e.pattern", "e.rank", "e.start", "e.end", "e.text", *keep)
    return rows.where(F.length("text") >= least)


def _named(found: Column, p: Pattern, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(p.type).alias("type"), F.lit(p.name).alias("pattern"), F.lit(rank).alias("rank")))


def extract_sql(source: str, patterns: tuple[Pattern, ...], key: str = "doc_id", text: str = "text") -> str:
    parts = [f"select {key}, '{p.type}' as type, '{p.name}' as pattern, {i}::int as rank, start, \"end\", text from {spans_sql(source, key, text, p.regex, p.fold, p.group)}" for i, p in enumerate(patterns)]
    return f"(select * from ({' union all '.join(parts)}) where length(text) >= {LEAST_LENGTH})"
