"""Rules for kinds of documents, recognisers with their registry, and the deny list."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.regex import spark_regex, sql_regex
from spanloom.operators.extract import Pattern, extract

_NAME = r"([A-Z][a-zA-ZÀ-ÿ'-]+(?:[ ]+[A-Z][a-zA-ZÀ-ÿ'-]+)*)"
# Invoice numbers, references and amounts.
INVOICE = (
    Pattern("INVOICE_NUMBER", "number_en", r"(?:invoice|inv|bill)\s*(?:no\.?|nr\.?|#|number|:)\s*([A-Z0-9][\w-]{2,20})", fold=True, group=True),
    Pattern("INVOICE_NUMBER", "number_de", r"(?:rechnung|rech|re)\s*(?:nr\.?|nummer|:)\s*([A-Z0-9][\w-]{2,20})", fold=True, group=True),
    Pattern("INVOICE_NUMBER", "number_fr", r"(?:facture|fact|fac)\s*(?:n[°o]\.?|numéro|:)\s*([A-Z0-9][\w-]{2,20})", fold=True, group=True),
    Pattern("INVOICE_NUMBER", "number_ref", r"(?:ref|reference|réf)\s*(?:no\.?|nr\.?|#|:)?\s*([A-Z0-9][\w-]{4,20})", fold=True, group=True),
    Pattern("PAYMENT_REF", "qr", r"\b\d{26,27}\b"),
    Pattern("PAYMENT_REF", "rf", r"RF\d{2}[A-Z0-9]{1,21}", fold=True),
    Pattern("PAYMENT_REF", "esr", r"\b\d{2}\s?\d{5}\s?\d{5}\s?\d{5}\s?\d{5}\s?\d{5}\s?\d{2}\b"),
    Pattern("AMOUNT", "chf", r"(?:chf|sfr)\s*[\d',.\s]{1,15}", fold=True),
    Pattern("AMOUNT", "eur", r"(?:eur|€)\s*[\d',.\s]{1,15}", fold=True),
)
# Salutations, closings and subject lines of letters.
LETTER = (
    Pattern("SALUTATION_NAME", "dear", r"\bDear\s+(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?)?\s*" + _NAME, fold=True, group=True),
    Pattern("SALUTATION_NAME", "cher", r"\bCher\s+(?:Monsieur|M\.)\s+" + _NAME, fold=True, group=True),
    Pattern("SALUTATION_NAME", "herr", r"\bHerr\s+" + _NAME, fold=True, group=True),
    Pattern("SALUTATION_NAME", "frau", r"\bFrau\s+" + _NAME, fold=True, group=True),
    Pattern("SALUTATION_NAME", "gentile", r"\bGentile\s+(?:Signor|Signora|Sig\.?|Sig\.?ra)\s+" + _NAME, fold=True, group=True),
    Pattern("SIGNATURE", "closing_en", r"(?:sincerely|best regards|kind regards|regards|yours truly|yours faithfully)[ ]*,?[ ]*\n+[ ]*" + _NAME, fold=True, group=True),
    Pattern("SIGNATURE", "closing_fr", r"(?:cordialement|meilleures salutations|salutations)[^\n]*\n+[ ]*" + _NAME, fold=True, group=True),
    Pattern("LETTER_DATE", "date_named", r"\b\d{1,2}\.?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|Januar|Februar|März|Juni|Juli|Oktober|Dezember)\s+\d{4}\b", fold=True),
    Pattern("LETTER_DATE", "date_numeric", r"\b\d{1,2}[./]\d{1,2}[./]\d{4}\b"),
    Pattern("REFERENCE_LINE", "subject", r"(?m)^(?:re|ref|reference|subject|betreff|betr|objet|concerne)[:.]?[ ]*([^\n]{5,100})$", fold=True, group=True),
)
SURER_AT_HEAD, HEAD = 0.2, 0.2


def rule_entities(docs: DataFrame, rules: tuple[Pattern, ...], confidence: float = 0.85) -> DataFrame:
    """Entities of the rules, surer in the first fifth of the text."""
    found = extract(docs, rules).join(docs.select("doc_id", F.length("text").alias("length")), "doc_id")
    boost = F.when(F.col("start") < F.col("length") * HEAD, SURER_AT_HEAD).otherwise(0.0)
    return found.withColumn("confidence", F.round(F.least(F.lit(1.0), confidence + boost), 4)).drop("length")


def amount_of(text: Column) -> Column:
    """(currency, value) of an amount: 1'234.56, 1.234,56 or 1,234.56; a null value if it is no number."""
    rest = F.btrim(F.regexp_replace(text, r"[^\d.,'\s]", ""))
    swiss = F.replace(F.replace(rest, F.lit("'"), F.lit("")), F.lit(","), F.lit("."))
    euro = F.replace(F.replace(rest, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.regexp_replace(rest, r"[,\s]", "")
    number = F.when(F.contains(rest, F.lit("'")), swiss).when(rest.rlike(r"\d+\.\d{3},\d{2}$"), euro).otherwise(plain)
    value = F.regexp_extract(F.btrim(number), r"^(\d+(?:\.\d+)?|\.\d+)", 1).try_cast("double")
    low = F.lower(text)
    kind = F.when(low.rlike("chf|sfr"), "CHF").when(low.rlike("eur|€"), "EUR").when(low.rlike(r"usd|\$"), "USD").when(low.rlike("gbp|£"), "GBP").otherwise("UNKNOWN")
    return F.struct(kind.alias("currency"), value.alias("value"))


#: What weakness leaves of a score.
WEAK = 0.4


@dataclass(frozen=True)
class Recognizer:
    """Patterns with scores; where it applies; what it must not find; and a validator of its finds."""

    name: str
    patterns: tuple[tuple[Pattern, float], ...]
    countries: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    priority: int = 0
    specificity: int = 0
    deny: tuple[str, ...] = ()
    deny_patterns: tuple[str, ...] = ()
    validator: Callable[[Column], Column] | None = None
    weak: bool = False
    global_deny: bool = False


@dataclass
class Registry:
    """Recognisers by name; one of a name replaces another only with a higher priority."""

    known: dict[str, Recognizer] = field(default_factory=dict)

    def register(self, r: Recognizer) -> bool:
        if r.name in self.known and r.priority <= self.known[r.name].priority:
            return False
        self.known[r.name] = r
        return True

    def load(self, config: list[dict]) -> list[str]:
        """Recognisers of a configuration: entries with name, type, regex and a score from 0 to 1; the names of those that aren't well formed are given back, and the
        others are registered all the same."""
        bad = []
        for entry in config:
            try:
                re.compile(entry["regex"])
                score = float(entry["score"])
                if not (0 <= score <= 1 and str(entry["name"]) and str(entry["type"])):
                    raise ValueError(entry)
                p = Pattern(entry["type"], entry["name"], entry["regex"])
                listed = {k: tuple(entry.get(k, ())) for k in ("countries", "languages", "deny", "deny_patterns")}
                self.register(Recognizer(entry["name"], ((p, score),), priority=int(entry.get("priority", 0)), specificity=int(entry.get("specificity", 0)), weak=bool(entry.get("weak", False)), **listed))
            except (KeyError, TypeError, ValueError, re.error):
                bad.append(str(entry.get("name", "")))
        return bad

    def chosen(self, countries: tuple[str, ...] = (), language: str | None = None) -> list[Recognizer]:
        """Those that apply, by priority, specificity and name; one without countries or languages applies everywhere."""
        fits = [r for r in self.known.values() if (not countries or not r.countries or set(countries) & set(r.countries)) and (not language or not r.languages or language in r.languages)]
        return sorted(fits, key=lambda r: (-r.priority, -r.specificity, r.name))

    def analyze(self, docs: DataFrame, countries: tuple[str, ...] = (), language: str | None = None, least: float = 0.0, types: tuple[str, ...] = (), low_types: tuple[str, ...] = ()) -> DataFrame:
        """All applying recognisers' finds with score, from one scan of the texts; patterns match in either case. What a recogniser or the global deny list denies is
        dropped, as is what its validator refuses. Weak recognisers' scores, and those of low_types, are multiplied by WEAK. types: only these."""
        order = [(r, p, score) for r in self.chosen(countries, language) for p, score in r.patterns if not types or p.type in types]
        ranks = {r.name: i for i, r in enumerate(self.chosen(countries, language))}
        if not order:
            return docs.sparkSession.createDataFrame([], "doc_id long, type string, pattern string, rank int, start int, end int, text string, recognizer string, score double")
        found = extract(docs, tuple(replace(p, fold=True) for _, p, _ in order), least=1)
        keep = F.lit(True)
        for i, (r, _, _) in enumerate(order):
            own = (is_denied(F.col("type"), F.col("text"), tuple(d.lower() for d in r.deny), {}) if r.deny else F.lit(False)) | (is_denied(F.col("type"), F.col("text")) if r.global_deny else F.lit(False))
            for p in r.deny_patterns:
                own = own | F.col("text").rlike(spark_regex(p))
            valid = F.coalesce(r.validator(F.col("text"))["valid"], F.lit(False)) if r.validator is not None else F.lit(True)
            keep = keep & F.when(F.col("rank") == i, ~own & valid).otherwise(F.lit(True))
        pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("rank") + 1)
        scores = [max(0.0, min(1.0, x * (WEAK if r.weak else 1.0) * (WEAK if p.type in low_types else 1.0))) for r, p, x in order]
        rows = found.where(keep).withColumns({"recognizer": pick([r.name for r, _, _ in order]), "score": F.round(pick(scores), 4), "rank": pick([ranks[r.name] for r, _, _ in order])})
        return rows.where(F.col("score") >= least)


# Words that are denied for all types, and patterns for some.
DENIED = (
    "montant", "libellé", "description", "quantité", "prix", "total", "sous-total", "tva", "rabais", "réduction", "référence", "numéro", "facture", "client", "fournisseur", "désignation", "unité", "remise", "ht", "ttc",
    "beschreibung", "betrag", "menge", "preis", "summe", "mwst", "zwischensumme", "rabatt", "referenz", "nummer", "rechnung", "kunde", "lieferant", "bezeichnung", "einheit", "netto", "brutto", "amount", "quantity", "price",
    "subtotal", "tax", "discount", "reference", "number", "invoice", "customer", "supplier", "unit", "net", "gross", "date", "datum",
)
DENIED_PATTERNS = {
    "PERSON_NAME": [
        r"^[A-Z]{2,4}$", r"^\d+$", r"(?i)^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)$", r"(?i)^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)$", r"(?i)^(?:Janv|Févr|Mars|Avr|Mai|Juin|Juil|Août|Sept|Oct|Nov|Déc)$",
        r"(?i)^(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)$",
    ],
}


def is_denied(type_: Column, text: Column, words: tuple[str, ...] = DENIED, patterns: dict[str, list[str]] | None = None) -> Column:
    """Whether the deny list has the text, in lower case and without outer space, or a pattern of the type fits it."""
    out = F.lower(F.btrim(text)).isin(*words) if words else F.lit(False)
    for kind, listed in (DENIED_PATTERNS if patterns is None else patterns).items():
        for p in listed:
            out = out | ((type_ == kind) & text.rlike(spark_regex(p.replace("(?i)", ""), fold="(?i)" in p)))
    return out


def is_denied_sql(type_: str, text: str, words: tuple[str, ...] = DENIED, patterns: dict[str, list[str]] | None = None) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words) or "''"
    parts = [f"({type_} = '{kind}' and regexp_matches({text}, {sql_regex(p.replace('(?i)', ''), fold='(?i)' in p)}))" for kind, ps in (DENIED_PATTERNS if patterns is None else patterns).items() for p in ps]
    return f"(lower(trim({text})) in ({listed}) or {' or '.join(parts) or 'false'})"


def not_denied(found: DataFrame, words: tuple[str, ...] = DENIED, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """found without texts that are denied: an anti join with the words, in lower case, and the patterns of the type."""
    spark = found.sparkSession
    denied = spark.createDataFrame([(w,) for w in words], "__denied string")
    rows = found.join(F.broadcast(denied), F.lower(F.btrim("text")) == F.col("__denied"), "left_anti")
    return rows.where(~is_denied(F.col("type"), F.col("text"), (), patterns))


def expand_occurrences(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """Every exact occurrence of the marked texts (doc_id, type, text) in their documents, steps overlapping included, that isn't marked: (doc_id, type, text, start, end).
    One search over the text finds each place by a look-ahead, so overlapping ones too."""
    rows = marked.select("doc_id", "type", "text").where(F.length("text") > 0).distinct().join(docs.select("doc_id", F.col("text").alias("full")), "doc_id")
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.col("text"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    gaps = F.regexp_extract_all("full", F.concat(F.lit(r"\G((?s:.*?))(?="), quoted, F.lit(r")(?s:.)")), F.lit(1))
    # each gap ends before a place, and the search goes on one character after it
    places = F.aggregate(gaps, F.struct(F.lit(-1).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, g: F.struct((a["at"] + F.length(g) + 1).alias("at"), F.array_append(a["out"], a["at"] + F.length(g) + 1).alias("out")), lambda a: a["out"])
    found = rows.where(F.contains("full", "text")).select("doc_id", "type", "text", F.explode(places).alias("start")).select("doc_id", "type", "text", "start", (F.col("start") + F.length("text")).alias("end"))
    return found.join(marked.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_anti").select("doc_id", "type", "text", "start", "end")


def fuzzy_replace(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """docs with replaced: every entry of the document's mapping (doc_id, original, token), found with up to two other signs between its letters, gives way to
    its token, longer originals first. Each document has patterns of its own, so its text is rewritten in Python."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for doc, text, pairs in zip(pdf["doc_id"], pdf["text"], pdf["pairs"], strict=True):
                entries = []
                for p in sorted(pairs if pairs is not None else [], key=lambda p: (-len(p["original"]), p["original"])):
                    clean = re.sub(r"[^\w]", "", p["original"], flags=re.A)
                    if len(p["original"]) <= 50 and 3 <= len(clean) <= 30:
                        entries.append(("[^a-zA-Z0-9]{0,2}?".join(map(re.escape, clean)), p["token"]))
                if entries:
                    whole = re.compile("|".join(f"(?P<g{i}>{e})" for i, (e, _) in enumerate(entries)), re.I)
                    text = whole.sub(lambda m, entries=entries: entries[int(m.lastgroup[1:])][1], text or "")
                out.append((doc, text))
            yield pd.DataFrame(out, columns=["doc_id", "replaced"])

    per = mapping.groupBy("doc_id").agg(F.collect_list(F.struct("original", "token")).alias("pairs"))
    return docs.select("doc_id", "text").join(per, "doc_id", "left").mapInPandas(run, "doc_id long, replaced string")
