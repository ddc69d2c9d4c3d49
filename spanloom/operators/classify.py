"""Document types: keywords of the text's language, structure and position, scored and ranked."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.regex import spark_regex, sql_regex

# Words that tell a text's language; ties go to the one that stands first.
INDICATORS = {
    "en": ["the", "and", "is", "are", "was", "were", "have", "has", "this", "that", "with", "for", "your", "please"],
    "fr": ["le", "la", "les", "de", "du", "des", "et", "est", "sont", "vous", "nous", "dans", "pour", "avec", "cette", "votre"],
    "de": ["der", "die", "das", "und", "ist", "sind", "ihr", "ihre", "wir", "mit", "für", "von", "bei", "nach", "bitte"],
    "it": ["il", "la", "le", "di", "del", "della", "e", "è", "sono", "con", "per", "nella", "questo", "questa"],
}
# Words that tell a document's type, by language.
INVOICE_WORDS = {
    "en": ["invoice", "bill", "payment due", "amount due", "subtotal", "total", "tax", "vat", "qty", "quantity", "unit price", "invoice number", "invoice date", "due date", "payment terms", "remittance"],
    "fr": ["facture", "montant", "total", "tva", "quantité", "prix unitaire", "numéro de facture", "date de facture", "échéance", "règlement", "net à payer", "ht", "ttc"],
    "de": ["rechnung", "rechnungsnummer", "betrag", "mwst", "mehrwertsteuer", "gesamtbetrag", "menge", "einzelpreis", "rechnungsdatum", "zahlbar", "fällig", "netto", "brutto"],
    "it": ["fattura", "importo", "totale", "iva", "quantità", "prezzo unitario", "numero fattura", "data fattura", "scadenza"],
}
LETTER_WORDS = {
    "en": ["dear", "sincerely", "regards", "yours truly", "yours faithfully", "best regards", "kind regards", "to whom it may concern", "enclosed", "please find", "i am writing", "we are writing", "thank you for", "re:", "subject:"],
    "fr": ["cher", "chère", "madame", "monsieur", "cordialement", "salutations", "veuillez agréer", "je vous prie", "meilleures salutations", "bien à vous", "ci-joint", "je vous écris", "nous vous écrivons", "objet:", "concerne:"],
    "de": ["sehr geehrte", "sehr geehrter", "liebe", "lieber", "mit freundlichen grüßen", "mit freundlichen grüssen", "hochachtungsvoll", "beste grüße", "beste grüsse", "anbei", "ich schreibe ihnen", "wir schreiben ihnen", "betreff:", "betrifft:"],
    "it": ["gentile", "egregio", "caro", "cara", "cordiali saluti", "distinti saluti", "cordialmente", "in allegato", "le scrivo", "oggetto:"],
}
FORM_WORDS = {
    "en": ["please fill", "please complete", "check box", "checkbox", "select one", "tick", "circle", "enter your", "your name", "your address", "date of birth", "signature", "sign here", "required field", "mandatory", "optional", "n/a", "not applicable", "yes/no", "yes / no"],
    "fr": ["veuillez remplir", "cochez", "case à cocher", "sélectionnez", "entrez", "votre nom", "votre adresse", "date de naissance", "signature", "champ obligatoire", "facultatif", "oui/non", "non applicable"],
    "de": ["bitte ausfüllen", "ankreuzen", "kontrollkästchen", "wählen sie", "ihr name", "ihre adresse", "geburtsdatum", "unterschrift", "pflichtfeld", "optional", "ja/nein", "nicht zutreffend", "n.z."],
    "it": ["compilare", "casella", "selezionare", "inserire", "nome", "indirizzo", "data di nascita", "firma", "obbligatorio", "facoltativo", "sì/no"],
}
CONTRACT_WORDS = {
    "en": ["agreement", "contract", "parties", "whereas", "hereby", "herein", "hereto", "thereto", "clause", "article", "section", "terms and conditions", "effective date", "termination", "obligations", "warranties", "indemnification", "governing law", "jurisdiction", "witness", "executed", "binding"],
    "fr": ["contrat", "accord", "parties", "attendu que", "par les présentes", "ci-après", "clause", "article", "conditions générales", "date d'entrée en vigueur", "résiliation", "obligations", "garanties", "loi applicable", "juridiction", "témoin", "signé"],
    "de": ["vertrag", "vereinbarung", "parteien", "hiermit", "klausel", "artikel", "paragraph", "allgemeine geschäftsbedingungen", "agb", "inkrafttreten", "kündigung", "pflichten", "gewährleistung", "anwendbares recht", "gerichtsstand", "zeuge", "unterzeichnet"],
    "it": ["contratto", "accordo", "parti", "premesso", "con la presente", "clausola", "articolo", "condizioni generali", "decorrenza", "risoluzione", "obblighi", "garanzie", "legge applicabile", "foro competente", "testimone", "sottoscritto"],
}
REPORT_WORDS = {
    "en": ["executive summary", "introduction", "conclusion", "findings", "recommendations", "analysis", "methodology", "results", "discussion", "appendix", "table of contents", "abstract", "overview", "summary", "background", "objectives", "scope", "key findings"],
    "fr": ["résumé exécutif", "introduction", "conclusion", "résultats", "recommandations", "analyse", "méthodologie", "discussion", "annexe", "table des matières", "sommaire", "contexte", "objectifs", "périmètre", "principales conclusions"],
    "de": ["zusammenfassung", "einleitung", "fazit", "ergebnisse", "empfehlungen", "analyse", "methodik", "diskussion", "anhang", "inhaltsverzeichnis", "überblick", "hintergrund", "ziele", "umfang", "kernaussagen"],
    "it": ["sommario", "introduzione", "conclusione", "risultati", "raccomandazioni", "analisi", "metodologia", "discussione", "allegato", "indice", "panoramica", "contesto", "obiettivi", "ambito"],
}
KEYWORDS = {"INVOICE": INVOICE_WORDS, "LETTER": LETTER_WORDS, "FORM": FORM_WORDS, "CONTRACT": CONTRACT_WORDS, "REPORT": REPORT_WORDS}
# Structures that tell it; each counts STRUCTURE_WEIGHT.
STRUCTURE = {
    "INVOICE": [r"(?:invoice|rechnung|facture)\s*(?:no\.?|nr\.?|#|:)\s*[\w-]+", r"(?:total|montant|betrag)\s*[:=]?\s*(?:chf|eur|usd|€|£|\$)?\s*[\d',.\s]+", r"(?:qty|menge|quantité)\s+(?:unit|preis|prix)", r"(?:chf|eur|usd)\s*[\d',.\s]+", r"\d+[.,]\d{2}\s*(?:chf|eur|usd|€)"],
    "LETTER": [r"(?m)^(?:dear|sehr geehrter?|cher|chère|madame|monsieur)", r"(?m)(?:sincerely|regards|cordialement|grüße|grüssen|salutations)\s*,?\s*$", r"(?m)^(?:re:|betreff:|objet:|subject:)", r"(?:enclosed|anbei|ci-joint|in allegato)"],
    "FORM": [r"\[\s*\]|\(\s*\)|□|☐|☑|☒", r"(?:name|nom):\s*_{2,}|_{5,}", r"(?:yes|no|oui|non|ja|nein)\s*(?:\[\s*\]|\(\s*\))", r"please\s+(?:check|tick|fill|complete)", r"\*\s*(?:required|obligatoire|pflichtfeld)"],
    "CONTRACT": [r"(?:between|entre|zwischen)\s+(?:the\s+)?(?:parties|parteien|les parties)", r"(?:article|clause|section)\s+\d+", r"(?:whereas|attendu que|in anbetracht)", r"(?:hereby|par les présentes|hiermit)\s+(?:agree|conviennent|vereinbaren)", r"(?:witness|témoin|zeuge)\s+(?:whereof|de quoi)"],
    "REPORT": [r"(?:table\s+of\s+contents|inhaltsverzeichnis|table\s+des\s+matières)", r"(?:executive\s+summary|zusammenfassung|résumé)", r"(?m)^(?:\d+\.|\d+\))\s+(?:introduction|methodology|results|conclusion)", r"(?:appendix|anhang|annexe)\s+[a-z\d]", r"(?:figure|table|abbildung|tabelle)\s+\d+"],
}
STRUCTURE_WEIGHT = 0.15
# What the first or last EDGE_LINES lines tell: (name, type, at the head, pattern, weight).
EDGES = [
    ("position:invoice_header", "INVOICE", True, r"invoice|rechnung|facture", 0.2),
    ("position:salutation_start", "LETTER", True, r"dear|sehr geehrte|cher|madame|monsieur", 0.2),
    ("position:signature_end", "LETTER", False, r"sincerely|regards|grüß|cordialement|salutations", 0.15),
    ("position:parties_clause", "CONTRACT", True, r"between|entre|zwischen.*parties|parteien", 0.2),
    ("position:toc_header", "REPORT", True, r"table of contents|inhaltsverzeichnis|table des matières", 0.25),
]
EDGE_LINES, LEAST, SECOND, FEATURES = 5, 0.25, 0.2, 10


# The rule sets that apply to a type.
RULE_SETS = {
    "INVOICE": ("vendor", "amount", "vatNumber", "paymentRef", "invoiceNumber"), "LETTER": ("sender", "recipient", "signature", "salutation"), "FORM": ("formField", "checkbox", "signature"),
    "CONTRACT": ("parties", "clauses", "signature", "date"), "REPORT": ("author", "sections", "references"),
}
THRESHOLDS = ("autoAnonymize", "flagForReview", "minConfidence")


def rules_of(kind: Column) -> Column:
    """The names of the rule sets of a type; an empty array for UNKNOWN."""
    out = F.array().cast("array<string>")
    for name, listed in RULE_SETS.items():
        out = F.when(kind == name, F.array(*[F.lit(x) for x in listed])).otherwise(out)
    return out


def rule_errors(config: dict) -> list[str]:
    """What is wrong with a rule configuration: no version, a type missing, or thresholds that don't descend."""
    kinds = config.get("documentTypes", {})
    out = [] if config.get("version") else ["no version"]
    out += [f"{k}: missing" for k in (*RULE_SETS, "UNKNOWN") if k not in kinds]
    for k, own in kinds.items():
        limits = own.get("thresholds")
        if limits:
            out += [f"{k}: {a} is less than {b}" for a, b in zip(THRESHOLDS, THRESHOLDS[1:], strict=False) if limits[a] < limits[b]]
    return out


def weight_of(word: str) -> float:
    """Of a keyword that occurs; it grows with half the logarithm of its count."""
    return 0.08 * min(len(word) / 8, 1.5)


def language_of(text: Column) -> Column:
    """The language whose indicators are most frequent in the whole text."""
    low = F.lower(text)
    counts = [F.struct(F.regexp_count(low, F.lit(spark_regex(rf"\b(?:{'|'.join(words)})\b"))).alias("n"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang")) for i, (lang, words) in enumerate(INDICATORS.items())]
    return F.array_max(F.array(*counts))["lang"]


def _keywords(lang: str) -> list[tuple[str, str, str, float]]:
    """(type, word, pattern, weight) of a language."""
    return [(kind, w, rf"\b{re.escape(w)}\b", weight_of(w)) for kind, by in KEYWORDS.items() for w in by.get(lang, by["en"])]


_HIT = "array<struct<type:string,name:string,weight:double>>"


def features(text: Column, lang: Column) -> Column:
    """What tells about the type: an array of (type, name, weight), keywords first, then structures and positions. A keyword's pattern is tried only
    where the keyword stands at all, and only those of the text's language."""
    low = F.lower(text)
    listed = None
    for name in INDICATORS:
        words = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(w).alias("word"), F.lit(spark_regex(p)).alias("pattern"), F.lit(x).alias("weight")) for k, w, p, x in _keywords(name)])
        listed = F.when(lang == name, words) if listed is None else listed.when(lang == name, words)
    there = F.filter(listed, lambda k: F.contains(low, k["word"]))
    counted = F.transform(there, lambda k: F.struct(k["type"].alias("type"), F.concat(F.lit("keyword:"), k["word"]).alias("name"), k["weight"].alias("weight"), F.regexp_count(low, k["pattern"]).alias("n")))
    found = F.transform(F.filter(counted, lambda k: k["n"] > 0), lambda k: F.struct(k["type"], k["name"], (k["weight"] * (1 + 0.5 * F.log2(k["n"] + 1))).alias("weight")))
    one = lambda kind, name, weight: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), F.lit(weight).alias("weight"))
    more = [F.when(text.rlike(spark_regex(p, fold=True)), one(k, f"pattern:{k.lower()}", STRUCTURE_WEIGHT)) for k, ps in STRUCTURE.items() for p in ps]
    lines = F.split(low, "\n", -1)
    head, tail = F.array_join(F.slice(lines, 1, EDGE_LINES), "\n"), F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - EDGE_LINES + 1), F.lit(EDGE_LINES)), "\n")
    more += [F.when((head if at_head else tail).rlike(p), one(k, name, w)) for name, k, at_head, p, w in EDGES]
    return F.concat(found.cast(_HIT), F.array_compact(F.array(*more)).cast(_HIT))


def classify(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with language, doc_type, confidence (a third of the score, at most 1), second and features: the best type if it suffices, else UNKNOWN; the next best, if its
    score does; the names of what weighs most, FEATURES at most. Ties go to what stands first in the tables. A null text has no type."""
    rows = docs.withColumn("language", language_of(F.col(text_col)))
    rows = rows.withColumn("__f", features(F.col(text_col), F.col("language")))
    total = lambda kind: F.round(F.aggregate("__f", F.lit(0.0), lambda a, x: a + F.when(x["type"] == kind, x["weight"]).otherwise(0.0)), 6)
    ranked = F.sort_array(F.array(*[F.struct(total(k).alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("type")) for i, k in enumerate(KEYWORDS)]), asc=False)
    rows = rows.withColumn("__r", ranked)
    sure = F.least(F.col("__r")[0]["score"] / 3, F.lit(1.0))
    heaviest = F.sort_array(F.transform("__f", lambda x, i: F.struct(F.round(-x["weight"], 6).alias("w"), i.alias("i"), x["name"].alias("name"))))
    out = {"doc_type": F.when(sure >= LEAST, F.col("__r")[0]["type"]).when(F.col(text_col).isNotNull(), "UNKNOWN"), "confidence": F.round(sure, 4), "second": F.when(F.col("__r")[1]["score"] > SECOND, F.col("__r")[1]["type"])}
    return rows.withColumns({**out, "features": F.transform(F.slice(heaviest, 1, FEATURES), lambda x: x["name"])}).drop("__f", "__r")


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def language_sql(text: str) -> str:
    n = {k: f"len(regexp_extract_all(lower({text}), {sql_regex(rf'{chr(92)}b(?:{"|".join(ws)}){chr(92)}b')}))" for k, ws in INDICATORS.items()}
    arms, names = [], list(n)
    for i, k in enumerate(names[:-1]):
        arms.append(f"when {n[k]} >= greatest({', '.join(n[x] for x in names[i + 1 :])}) then '{k}'")
    return f"case {' '.join(arms)} else '{names[-1]}' end"


def classify_sql(source: str) -> str:
    """SQL for (doc_id, language, doc_type, confidence, second, features), features joined by commas."""
    words = ", ".join(f"({_text(lang)}, {i}, {_text(k)}, {_text(w)}, {sql_regex(p)}, {x!r}::double)" for lang in INDICATORS for i, (k, w, p, x) in enumerate(_keywords(lang)))
    fixed = [(k, f"pattern:{k.lower()}", STRUCTURE_WEIGHT, f"regexp_matches(text, {sql_regex(p, fold=True)})") for k, ps in STRUCTURE.items() for p in ps]
    lines = "string_split(lower(text), chr(10))"
    fixed += [(k, name, w, f"regexp_matches(array_to_string({lines}[{f':{EDGE_LINES}' if at_head else f'-{EDGE_LINES}:'}], chr(10)), {sql_regex(p)})") for name, k, at_head, p, w in EDGES]
    rest = " union all ".join(f"select doc_id, {1000 + i} as i, '{k}' as type, '{name}' as name, {w}::double as weight from d where {test}" for i, (k, name, w, test) in enumerate(fixed))
    kinds = ", ".join(f"({i}, '{k}')" for i, k in enumerate(KEYWORDS))
    return f"""with d as materialized (select doc_id, text, {language_sql("text")} as language from {source}), w(lang, i, type, word, pattern, weight) as (values {words}), k(rank, type) as (values {kinds}),
n as (select doc_id, i, type, 'keyword:' || word as name, weight, len(regexp_extract_all(lower(text), pattern)) as n from d join w on language = lang and contains(lower(text), word)),
f as (select doc_id, i, type, name, weight * (1 + 0.5 * log2(n + 1)) as weight from n where n > 0 union all {rest}),
s as (select d.doc_id, k.rank, k.type, round(coalesce(sum(weight), 0), 6) as score from d cross join k left join f on f.doc_id = d.doc_id and f.type = k.type group by all),
r as (select *, row_number() over (partition by doc_id order by score desc, rank) as n from s),
top as (select doc_id, string_agg(name, ',' order by n) as features from (select doc_id, name, row_number() over (partition by doc_id order by round(weight, 6) desc, i) as n from f) where n <= {FEATURES} group by doc_id),
b as (select doc_id, max(case when n = 1 then case when least(score / 3, 1) >= {LEAST} then type else 'UNKNOWN' end end) as doc_type, max(case when n = 1 then round(least(score / 3, 1.0), 4) end) as confidence, max(case when n = 2 and score > {SECOND} then type end) as second from r group by doc_id)
select doc_id, language, doc_type, confidence, second, coalesce(features, '') as features from d join b using (doc_id) left join top using (doc_id)"""
