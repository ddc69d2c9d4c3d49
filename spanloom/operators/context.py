"""Confidence from context words around an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import LEMMA_RULES, lemma, lemma_sql

# Words that speak for a type, or, with a negative weight, against it, by language.
PERSON_WORDS = {
    "en": {
        "mr": 1.0, "mrs": 1.0, "ms": 1.0, "miss": 1.0, "dr": 1.0, "prof": 1.0, "sir": 0.9, "madam": 0.9, "name": 0.9, "full name": 1.0, "first name": 0.9, "last name": 0.9, "surname": 0.9, "given name": 0.9, "contact": 0.8, "attention": 0.8, "attn": 0.8,
        "dear": 0.7, "recipient": 0.8, "by": 0.6, "from": 0.6, "to": 0.6, "author": 0.7, "owner": 0.7, "manager": 0.7, "director": 0.7, "signed": 0.6, "approved": 0.6, "employee": 0.7, "customer": 0.7, "client": 0.7,
        "example.com": -0.9, "test@": -0.8, "lorem": -0.7, "ipsum": -0.7, "placeholder": -0.8, "ltd": -1.0, "inc": -1.0, "corp": -1.0, "llc": -1.0, "plc": -1.0, "group": -0.9, "holding": -0.9, "technologies": -0.9, "services": -0.8, "solutions": -0.8,
        "street": -0.9, "road": -0.9, "avenue": -0.9, "lane": -0.9,
    },
    "fr": {
        "m.": 1.0, "mme": 1.0, "mlle": 1.0, "dr": 1.0, "prof": 1.0, "monsieur": 1.0, "madame": 1.0, "mademoiselle": 0.9, "nom": 0.9, "prénom": 0.9, "nom complet": 1.0, "nom de famille": 0.9, "contact": 0.8, "attention": 0.8, "cher": 0.7, "chère": 0.7,
        "destinataire": 0.8, "par": 0.6, "de": 0.5, "à": 0.5, "auteur": 0.7, "propriétaire": 0.7, "responsable": 0.7, "directeur": 0.7, "signé": 0.6, "approuvé": 0.6, "employé": 0.7, "client": 0.7, "exemple.com": -0.9, "test@": -0.8,
        "sa": -1.0, "sàrl": -1.0, "sarl": -1.0, "cie": -0.9, "groupe": -0.9, "holding": -0.9, "technologies": -0.9, "services": -0.8, "rue": -0.9, "avenue": -0.9, "boulevard": -0.9, "chemin": -0.9, "route": -0.9, "place": -0.9,
        "via": -0.9, "viale": -0.9, "piazza": -0.9,
    },
    "de": {
        "herr": 1.0, "frau": 1.0, "dr": 1.0, "dr.": 1.0, "prof": 1.0, "prof.": 1.0, "sehr geehrter": 1.0, "sehr geehrte": 1.0, "lieber": 0.8, "liebe": 0.8, "name": 0.9, "vorname": 0.9, "nachname": 0.9, "vollständiger name": 1.0, "familienname": 0.9,
        "kontakt": 0.8, "achtung": 0.8, "empfänger": 0.8, "von": 0.6, "an": 0.6, "autor": 0.7, "eigentümer": 0.7, "verantwortlich": 0.7, "direktor": 0.7, "unterschrieben": 0.6, "genehmigt": 0.6, "mitarbeiter": 0.7, "kunde": 0.7,
        "beispiel.com": -0.9, "test@": -0.8, "ag": -1.0, "gmbh": -1.0, "kg": -0.9, "ohg": -0.9, "se": -0.9, "gruppe": -0.9, "holding": -0.9, "technologien": -0.9, "dienstleistungen": -0.8,
        "strasse": -0.9, "straße": -0.9, "gasse": -0.9, "weg": -0.9, "platz": -0.9, "allee": -0.9,
    },
}
PHONE_WORDS = {
    "en": {"phone": 1.0, "tel": 1.0, "telephone": 1.0, "mobile": 0.9, "cell": 0.9, "cellphone": 0.9, "fax": 0.8, "call": 0.7, "contact": 0.7, "number": 0.6, "direct": 0.7, "office": 0.7, "home": 0.6, "work": 0.6, "order": -0.6, "invoice": -0.6, "reference": -0.6},
    "fr": {"téléphone": 1.0, "tél": 1.0, "tél.": 1.0, "mobile": 0.9, "portable": 0.9, "natel": 0.9, "fax": 0.8, "appeler": 0.7, "contact": 0.7, "numéro": 0.6, "direct": 0.7, "bureau": 0.7, "domicile": 0.6, "travail": 0.6, "commande": -0.6, "facture": -0.6, "référence": -0.6},
    "de": {"telefon": 1.0, "tel": 1.0, "tel.": 1.0, "mobil": 0.9, "handy": 0.9, "natel": 0.9, "fax": 0.8, "anrufen": 0.7, "kontakt": 0.7, "nummer": 0.6, "direkt": 0.7, "büro": 0.7, "privat": 0.6, "geschäftlich": 0.6, "bestellung": -0.6, "rechnung": -0.6, "referenz": -0.6},
}
EMAIL_WORDS = {
    "en": {"email": 1.0, "e-mail": 1.0, "mail": 0.8, "contact": 0.7, "address": 0.6, "send": 0.6, "write": 0.6, "message": 0.6, "reply": 0.6, "example.com": -0.9, "test.com": -0.9, "domain.com": -0.8, "placeholder": -0.8},
    "fr": {"courriel": 1.0, "e-mail": 1.0, "email": 1.0, "mail": 0.8, "contact": 0.7, "adresse": 0.6, "envoyer": 0.6, "écrire": 0.6, "message": 0.6, "répondre": 0.6, "exemple.com": -0.9, "test.com": -0.9},
    "de": {"email": 1.0, "e-mail": 1.0, "mail": 0.8, "kontakt": 0.7, "adresse": 0.6, "senden": 0.6, "schreiben": 0.6, "nachricht": 0.6, "antworten": 0.6, "beispiel.com": -0.9, "test.com": -0.9},
}
ADDRESS_WORDS = {
    "en": {"address": 1.0, "street": 0.9, "road": 0.8, "avenue": 0.8, "boulevard": 0.8, "lane": 0.7, "postal": 0.8, "zip": 0.8, "city": 0.7, "town": 0.7, "location": 0.6, "deliver": 0.7, "ship": 0.7, "mail to": 0.8, "residence": 0.8, "domicile": 0.8},
    "fr": {"adresse": 1.0, "rue": 0.9, "avenue": 0.8, "chemin": 0.8, "boulevard": 0.8, "route": 0.7, "postal": 0.8, "code": 0.6, "npa": 0.9, "ville": 0.7, "localité": 0.7, "livrer": 0.7, "livraison": 0.7, "domicile": 0.8, "résidence": 0.8},
    "de": {"adresse": 1.0, "strasse": 0.9, "straße": 0.9, "weg": 0.8, "platz": 0.8, "allee": 0.8, "postleitzahl": 0.9, "plz": 0.9, "stadt": 0.7, "ort": 0.7, "ortschaft": 0.7, "liefern": 0.7, "lieferung": 0.7, "wohnort": 0.8, "anschrift": 0.9},
}
IBAN_WORDS = {
    "en": {"iban": 1.0, "account": 0.8, "bank": 0.8, "bank account": 1.0, "transfer": 0.7, "payment": 0.7, "swift": 0.8, "bic": 0.8, "wire": 0.7, "deposit": 0.7},
    "fr": {"iban": 1.0, "compte": 0.8, "compte bancaire": 1.0, "banque": 0.8, "virement": 0.7, "paiement": 0.7, "swift": 0.8, "bic": 0.8, "versement": 0.7},
    "de": {"iban": 1.0, "konto": 0.8, "bankkonto": 1.0, "bank": 0.8, "überweisung": 0.7, "zahlung": 0.7, "swift": 0.8, "bic": 0.8, "einzahlung": 0.7},
}
AVS_WORDS = {
    "en": {"avs": 1.0, "ahv": 1.0, "social security": 0.9, "social insurance": 0.9, "insurance number": 0.8, "ssn": 0.7},
    "fr": {"avs": 1.0, "numéro avs": 1.0, "n° avs": 1.0, "sécurité sociale": 0.9, "assurance sociale": 0.9, "numéro d'assurance": 0.8},
    "de": {"ahv": 1.0, "ahv-nummer": 1.0, "ahv-nr": 1.0, "sozialversicherung": 0.9, "versicherungsnummer": 0.8, "svn": 0.7},
}
POSTAL_WORDS = {
    "en": {"postal": 0.9, "postal code": 1.0, "zip": 0.8, "zip code": 1.0, "npa": 0.9, "postcode": 0.9},
    "fr": {"postal": 0.9, "code postal": 1.0, "npa": 1.0, "localité": 0.7},
    "de": {"postleitzahl": 1.0, "plz": 1.0, "ort": 0.7, "ortschaft": 0.7},
}
DATE_WORDS = {
    "en": {"date": 0.8, "born": 0.9, "birth": 0.9, "birthday": 0.9, "dob": 1.0, "date of birth": 1.0, "issued": 0.7, "expires": 0.7, "expiry": 0.7, "valid": 0.6, "effective": 0.6, "invoice date": -0.4, "order date": -0.4, "due date": -0.4},
    "fr": {"date": 0.8, "né": 0.9, "née": 0.9, "naissance": 1.0, "date de naissance": 1.0, "émis": 0.7, "expire": 0.7, "expiration": 0.7, "valide": 0.6, "date de facture": -0.4, "date de commande": -0.4, "échéance": -0.4},
    "de": {"datum": 0.8, "geboren": 0.9, "geburt": 0.9, "geburtsdatum": 1.0, "ausgestellt": 0.7, "gültig": 0.6, "ablauf": 0.7, "rechnungsdatum": -0.4, "bestelldatum": -0.4, "fälligkeitsdatum": -0.4},
}
ORGANIZATION_WORDS = {
    "en": {"company": 0.9, "corporation": 0.9, "organization": 0.9, "organisation": 0.9, "firm": 0.8, "enterprise": 0.8, "business": 0.7, "ltd": 0.9, "inc": 0.9, "corp": 0.9, "llc": 0.9, "plc": 0.9},
    "fr": {"société": 0.9, "entreprise": 0.9, "organisation": 0.9, "firme": 0.8, "sa": 0.9, "sàrl": 0.9, "sarl": 0.9, "cie": 0.8},
    "de": {"firma": 0.9, "unternehmen": 0.9, "gesellschaft": 0.9, "organisation": 0.9, "gmbh": 1.0, "ag": 1.0, "kg": 0.9, "ohg": 0.9},
}
#: By type; a parameter of the enhancer. PHONE is this library's name of phone numbers.
CONTEXT_WORDS = {"PERSON_NAME": PERSON_WORDS, "PHONE": PHONE_WORDS, "EMAIL": EMAIL_WORDS, "ADDRESS": ADDRESS_WORDS, "IBAN": IBAN_WORDS, "SWISS_AVS": AVS_WORDS, "SWISS_POSTAL_CODE": POSTAL_WORDS, "DATE": DATE_WORDS, "ORGANIZATION": ORGANIZATION_WORDS}
WINDOWS = {"PERSON_NAME": 150, "IBAN": 40, "EMAIL": 50, "PHONE": 60, "SWISS_AVS": 60}
WINDOW, BEFORE, AFTER, FACTOR, FLOOR, RUNTIME = 100, 1.2, 0.8, 0.35, 0.4, 0.8
#: Most that a column's hint adds, and what it adds unless it says.
MOST_COLUMN, COLUMN = 0.5, 0.2
_WORD = "struct<word:string,stem:string,weight:double>"


def stem_of(word: str, language: str = "en") -> str:
    """lemma() of a word that the driver knows."""
    if len(word) < 3:
        return word
    return next((word[: len(word) - len(s)] + new for s, new, least in LEMMA_RULES[language] if word.lower().endswith(s) and len(word) - len(s) >= least), word)


def _words(listed: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(w).alias("word"), F.lit(stem_of(w)).alias("stem"), F.lit(float(x)).alias("weight")) for w, x in listed.items()]).cast(f"array<{_WORD}>")


def words_of(type_: Column, lang: Column, words: dict[str, dict[str, dict[str, float]]]) -> Column:
    """The context words of a type and language; an empty array where there are none."""
    out = None
    for kind, by in words.items():
        for name, listed in by.items():
            arm = (type_ == kind) & (lang == name)
            out = F.when(arm, _words(listed)) if out is None else out.when(arm, _words(listed))
    none = F.array().cast(f"array<{_WORD}>")
    return none if out is None else out.otherwise(none)


def enhance(found: DataFrame, words: dict[str, dict[str, dict[str, float]]] | None = None, runtime: tuple[str, ...] = (), regions: DataFrame | None = None, denied: Column | None = None) -> DataFrame:
    """found (with full, the whole text, lang and confidence) with enhanced: words of the type and language in the windows before and after the span, as
    such or by their lemma, raise or lower the confidence, those before more than those after; a raise ends at FLOOR at least.

    runtime: further words for all entities. regions: (doc_id, from, to, words), whose words (array<string>) count for entities within them.
    denied: where it holds, the confidence stays. Nothing is shuffled without regions.
    """
    listed = words_of(F.col("type"), F.col("lang"), CONTEXT_WORDS if words is None else words)
    if runtime:
        listed = F.concat(listed, _words({w.lower(): RUNTIME for w in runtime}))
    window = F.coalesce(F.create_map(*[F.lit(x) for kv in WINDOWS.items() for x in kv])[F.col("type")], F.lit(WINDOW))
    before = F.lower(F.substring(F.col("full"), F.greatest(F.lit(1), F.col("start") - window + 1), F.least(window, F.col("start"))))
    after = F.lower(F.substring(F.col("full"), F.col("end") + 1, window))
    rows = found.withColumns({"__b": before, "__a": after})
    if regions is not None:
        # the windows are cut out before, so that whole texts aren't shuffled; never a broadcast, since regions grow with the documents
        one = F.struct(F.col("from"), F.col("to"), F.col("words"))
        r = regions.where("words is not null").groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list(one).alias("__regions")).hint("merge")
        rows = rows.join(r, F.col("doc_id") == F.col("__d"), "left")
        own = F.filter(F.coalesce("__regions", F.array().cast(r.schema["__regions"].dataType)), lambda x: (F.col("start") >= x["from"]) & (F.col("end") <= x["to"]))
        more = F.transform(F.flatten(F.transform(own, lambda x: x["words"])), lambda w: F.struct(F.lower(w).alias("word"), lemma(F.lower(w)).alias("stem"), F.lit(RUNTIME).alias("weight")))
        listed = F.concat(listed, more.cast(f"array<{_WORD}>"))
    lemmas = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9_]+"), F.lit(0)), lambda w: lemma(w))
    rows = rows.withColumns({"__words": listed, "__lb": lemmas(F.col("__b")), "__la": lemmas(F.col("__a"))})

    def part(sign: int) -> Column:
        def step(acc: Column, w: Column) -> Column:
            pre = F.contains(F.col("__b"), w["word"]) | F.array_contains(F.col("__lb"), w["stem"])
            post = F.contains(F.col("__a"), w["word"]) | F.array_contains(F.col("__la"), w["stem"])
            worth = F.abs(w["weight"]) * F.least(F.lit(2.0), F.when(pre, BEFORE).otherwise(0.0) + F.when(post, AFTER).otherwise(0.0))
            return acc + F.when(F.signum(w["weight"]) == sign, worth).otherwise(0.0)

        return F.least(F.lit(FACTOR), F.aggregate("__words", F.lit(0.0), step) / BEFORE * FACTOR)

    rows = rows.withColumns({"__up": part(1), "__down": part(-1)})
    moved = F.col("confidence") + F.col("__up") - F.col("__down")
    moved = F.when(F.col("__up") > F.col("__down"), F.greatest(moved, F.lit(FLOOR))).otherwise(moved)
    if denied is not None:
        moved = F.when(denied, F.col("confidence")).otherwise(moved)
    return rows.withColumn("enhanced", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 6)).drop("__words", "__b", "__a", "__lb", "__la", "__up", "__down", "__d", "__regions")


def enhance_sql(found: str, runtime: tuple[str, ...] = ()) -> str:
    """SQL for (found's columns, enhanced); found has type, lang, full, start, end, confidence and a key k."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    listed = [(kind, lang, w, x) for kind, by in CONTEXT_WORDS.items() for lang, ws in by.items() for w, x in ws.items()]
    values = ", ".join(f"({text(kind)}, {text(lang)}, {text(w)}, {text(stem_of(w))}, {abs(x)!r}::double, {1 if x > 0 else -1})" for kind, lang, w, x in listed)
    always = "".join(f" union all select k, {text(w.lower())}, {text(stem_of(w.lower()))}, {RUNTIME}::double, 1 from c" for w in runtime)
    window = "case type " + " ".join(f"when '{k}' then {n}" for k, n in WINDOWS.items()) + f" else {WINDOW} end"
    lemmas = lambda c: f"list_transform(regexp_extract_all({c}, '[a-zA-Z0-9_]+'), lambda w: {lemma_sql('w')})"
    return f"""select * exclude (b, a, lb, la, up, down), round(greatest(0.0, least(1.0, case when up > down then greatest(confidence + up - down, {FLOOR}) else confidence + up - down end)), 6)::double as enhanced from (
  with w(type, lang, word, stem, x, sign) as (values {values}),
  c as materialized (select *, {lemmas("b")} as lb, {lemmas("a")} as la from (select *, lower(substr("full", greatest(0, start - {window}) + 1, least(start, {window}))) as b, lower(substr("full", "end" + 1, {window})) as a from ({found}))),
  l as (select k, word, stem, x, sign from c join w using (type, lang){always}),
  p as (select c.k, sign, sum(x * least(2.0, case when contains(b, word) or list_contains(lb, stem) then {BEFORE} else 0 end + case when contains(a, word) or list_contains(la, stem) then {AFTER} else 0 end)) as s from c join l using (k) group by all)
  select c.*, least({FACTOR}, coalesce(u.s, 0) / {BEFORE} * {FACTOR}) as up, least({FACTOR}, coalesce(d.s, 0) / {BEFORE} * {FACTOR}) as down from c left join p u on c.k = u.k and u.sign = 1 left join p d on c.k = d.k and d.sign = -1)"""


def column_boost(entities: DataFrame, hints: DataFrame) -> DataFrame:
    """entities (with column) with boosted: a hint (column, type, boost or null), matched in either case, raises the confidence of its column's entities of its type
    by its boost, COLUMN by default, from 0 to MOST_COLUMN; of several hints the first by boost counts. hints are a table of a few rows, and broadcast."""
    h = hints.groupBy(F.lower("column").alias("__c"), F.upper("type").alias("__t")).agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(MOST_COLUMN), F.coalesce("boost", F.lit(COLUMN))))).alias("__boost"))
    rows = entities.join(F.broadcast(h), (F.lower("column") == F.col("__c")) & (F.col("type") == F.col("__t")), "left")
    return rows.withColumn("boosted", F.round(F.least(F.lit(1.0), F.col("confidence") + F.coalesce("__boost", F.lit(0.0))), 6)).drop("__c", "__t", "__boost")
