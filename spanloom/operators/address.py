"""Postal addresses: components, links between them, patterns and scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import spans
from spanloom.operators.extract import Pattern, extract

# The ends that German street names have, and the words that others begin with.
STREET_ENDS = ["strasse", "straße", "str.", "str", "weg", "gasse", "platz", "allee", "ring", "damm"]
STREET_WORDS = ["rue", "avenue", "av.", "boulevard", "blvd", "chemin", "ch.", "place", "pl.", "route", "rte", "allée", "impasse", "passage", "quai", "via", "viale", "piazza", "corso", "vicolo", "largo", "street", "road", "lane", "drive", "court"]
# Swiss cities, in their languages.
CITIES = {
    "zurich": ["zürich", "zurich", "zurigo"], "geneva": ["genève", "geneva", "genf", "ginevra"], "basel": ["basel", "bâle", "basilea"], "bern": ["bern", "berne", "berna"], "lausanne": ["lausanne", "losanna"],
    "winterthur": ["winterthur", "winterthour"], "lucerne": ["luzern", "lucerne", "lucerna"], "stgallen": ["st. gallen", "st.gallen", "saint-gall", "san gallo"], "lugano": ["lugano"], "biel": ["biel", "bienne"],
    "thun": ["thun", "thoune"], "fribourg": ["fribourg", "freiburg", "friburgo"], "neuchatel": ["neuchâtel", "neuchatel", "neuenburg"], "sion": ["sion", "sitten"], "chur": ["chur", "coire", "coira"], "montreux": ["montreux"],
    "zug": ["zug", "zoug"],
}
# Countries, in their languages and by code.
COUNTRIES = ["switzerland", "suisse", "schweiz", "svizzera", "germany", "allemagne", "deutschland", "france", "frankreich", "francia", "italy", "italie", "italien", "italia", "austria", "autriche", "österreich", "liechtenstein"]
# Cantons by the first and last postal code of a range.
CANTONS = [
    (1000, 1299, "VD"), (1300, 1399, "VD/VS"), (1400, 1499, "VD"), (1500, 1699, "FR/VD"), (1700, 1799, "FR"), (1800, 1899, "VD/VS"), (1900, 1999, "VS"), (2000, 2299, "NE"), (2300, 2499, "NE/BE"),
    (2500, 2599, "BE"), (2600, 2699, "BE/SO"), (2700, 2799, "BE/JU"), (2800, 2999, "JU"), (3000, 3999, "BE"), (4000, 4999, "BS/BL/SO/AG"), (5000, 5999, "AG/SO"), (6000, 6999, "LU/ZG/SZ/NW/OW/UR/TI"), (7000, 7999, "GR"),
    (8000, 8999, "ZH/SH/TG/SG"), (9000, 9999, "SG/AR/AI/TG/SH"),
]

_any = lambda xs: "|".join(x.replace(".", r"\.") for x in sorted(xs, key=lambda x: (-len(x), x)))
COMPONENTS = (
    Pattern("STREET_NAME", "street_end", rf"[A-ZÄÖÜ][a-zäöüéèàâêîôûç]+(?:{_any(STREET_ENDS)})\b", fold=True),
    Pattern("STREET_NAME", "street_word", rf"\b(?:{_any(STREET_WORDS)})[ ]+(?:de[ ]+la[ ]+|de[ ]+|du[ ]+|des[ ]+|della[ ]+|del[ ]+)?[A-ZÄÖÜ][a-zäöüéèàâêîôûç]+", fold=True),
    Pattern("STREET_NUMBER", "number", r"\b\d{1,4}[a-zA-Z]?\b"),
    Pattern("POSTAL_CODE", "postal", r"\b(?:(?:CH|D|A|F|I)[- ]?)?[1-9]\d{3,4}\b"),
    Pattern("CITY", "city", rf"\b(?:{_any([v for vs in CITIES.values() for v in vs])})\b", fold=True),
    Pattern("COUNTRY", "country", rf"\b(?:{_any(COUNTRIES)})\b", fold=True),
)

NEAR, LEAST, MOST = 50, 2, 6
# Which component may follow which.
FOLLOWS = {"STREET_NAME": ("STREET_NUMBER", "POSTAL_CODE", "CITY"), "STREET_NUMBER": ("POSTAL_CODE", "CITY", "STREET_NAME"), "POSTAL_CODE": ("CITY", "COUNTRY", "STREET_NAME"), "CITY": ("COUNTRY", "POSTAL_CODE"), "COUNTRY": ()}


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, type, start, end, text) of address components; numbers only within NEAR characters of a street: a semi join by document and range."""
    found = extract(docs, tuple(p for p in COMPONENTS if p.type != "STREET_NUMBER")).select("doc_id", "type", "start", "end", "text")
    numbers = _numbers(docs)
    streets = found.where("type = 'STREET_NAME'").select(F.col("doc_id").alias("sd"), F.col("start").alias("ss"), F.col("end").alias("se"))
    near = F.least(F.abs(F.col("start") - F.col("se")), F.abs(F.col("start") - F.col("ss"))) <= NEAR
    return found.unionByName(numbers.join(streets, (F.col("doc_id") == F.col("sd")) & near, "left_semi"))


def _numbers(docs: DataFrame) -> DataFrame:
    p = COMPONENTS[2]
    rows = docs.select("doc_id", F.explode(spans(F.col("text"), p.regex)).alias("s"))
    return rows.select("doc_id", F.lit(p.type).alias("type"), "s.start", "s.end", "s.text")


def canton(code: Column) -> Column:
    """The cantons of a Swiss postal code, by range."""
    arm = None
    for low, high, name in CANTONS:
        arm = F.when(code.between(low, high), name) if arm is None else arm.when(code.between(low, high), name)
    return arm


#: What no address holds.
LINKED = r"\bwww\b|\.ch\b|\.com\b|http"


def link_components(found: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, group, start, end, types, texts): groups of components that follow each other by the table of transitions, within NEAR characters, of LEAST to MOST.
    With docs (doc_id, text), a blank line ends a group, and groups whose text holds a link aren't given.

    The walk skips components and starts anew from the unused ones, so each document's components, a short list, are walked in Python.
    """
    blank, linked = re.compile(r"\n\s*\n"), re.compile(LINKED, re.I | re.A)

    def walk(docs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in docs:
            out = []
            for doc, comps, full in zip(pdf["doc_id"], pdf["c"], pdf["full"], strict=True):
                items = [(c["start"], c["end"], c["type"], c["text"]) for c in comps]
                used: set[int] = set()
                n = 0
                for i, first in enumerate(items):
                    if i in used:
                        continue
                    group, kinds = [first], {first[2]}
                    used.add(i)
                    for j in range(i + 1, len(items)):
                        if len(group) >= MOST:
                            break
                        if j in used:
                            continue
                        gap = items[j][0] - group[-1][1]
                        if gap > NEAR or (full is not None and gap > 0 and blank.search(full, group[-1][1], items[j][0])):
                            break
                        kind = items[j][2]
                        if gap >= 0 and (kind not in kinds or kind == "STREET_NAME") and kind in FOLLOWS[group[-1][2]]:
                            group.append(items[j])
                            kinds.add(kind)
                            used.add(j)
                    if len(group) >= LEAST and not (full is not None and linked.search(full, group[0][0], max(g[1] for g in group))):
                        out.append((doc, n, group[0][0], max(g[1] for g in group), [g[2] for g in group], [g[3] for g in group]))
                        n += 1
            yield pd.DataFrame(out, columns=["doc_id", "group", "start", "end", "types", "texts"])

    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", "text"))).alias("c"))
    rows = rows.withColumn("full", F.lit(None).cast("string")) if docs is None else rows.join(docs.select("doc_id", F.col("text").alias("full")), "doc_id", "left")
    return rows.mapInPandas(walk, "doc_id long, group int, start int, end int, types array<string>, texts array<string>")


def pattern_of(types: Column) -> Column:
    """EU, SWISS, ALTERNATIVE, PARTIAL or NONE, from the types in their order."""
    has = lambda t: F.array_contains(types, t)
    street_first = F.array_position(types, "STREET_NAME") < F.array_position(types, "POSTAL_CODE")
    full = has("STREET_NAME") & has("POSTAL_CODE") & has("CITY")
    some = ((has("STREET_NAME") | has("STREET_NUMBER")) & (has("POSTAL_CODE") | has("CITY"))) | (has("POSTAL_CODE") & has("CITY"))
    return F.when(full & has("COUNTRY"), "EU").when(full & street_first, "SWISS").when(full, "ALTERNATIVE").when(some, "PARTIAL").otherwise("NONE")


def confidence_of(pattern: Column, types: Column) -> Column:
    has = lambda t: F.array_contains(types, t)
    base = F.when(pattern.isin("SWISS", "EU"), 0.85).when(pattern == "ALTERNATIVE", 0.75).when(pattern == "PARTIAL", 0.5).otherwise(0.3)
    more = F.greatest(F.lit(0), F.size(types) - LEAST) * 0.02 + F.when(has("STREET_NAME") & has("STREET_NUMBER"), 0.05).otherwise(0.0) + F.when(has("POSTAL_CODE") & has("CITY"), 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), base + more), 6)


def score_of(pattern: Column, types: Column, texts: Column) -> Column:
    """Completeness, pattern, postal code, city and country, out of 1.7."""
    part = lambda t: F.get(texts, F.array_position(types, t).cast("int") - 1)
    has = lambda t: F.array_contains(types, t)
    digits = F.regexp_replace(part("POSTAL_CODE"), "[^0-9]", "")
    swiss = (F.length(digits) == 4) & canton(digits.try_cast("int")).isNotNull()
    known = F.lower(part("CITY")).isin(*[v for vs in CITIES.values() for v in vs])
    parts = [
        F.least(F.size(F.array_distinct(types)) * 0.2, F.lit(1.0)),
        F.when(pattern.isin("SWISS", "EU"), 0.3).when(pattern == "ALTERNATIVE", 0.24).when(pattern == "PARTIAL", 0.15).otherwise(0.0),
        F.when(~has("POSTAL_CODE"), 0.0).when(swiss, 0.2).when(F.length(digits) == 5, 0.16).when(F.length(digits) == 4, 0.14).otherwise(0.06),
        F.when(~has("CITY"), 0.0).when(known, 0.1).when(has("POSTAL_CODE"), 0.05).otherwise(0.03),
        F.when(has("COUNTRY"), 0.1).otherwise(0.0),
    ]
    return F.round(sum(parts[1:], parts[0]) / 1.7, 6)


SWISS_CODE = r"^[1-9]\d{3}$"
# What names Switzerland in a country.
SWISS_NAMES = ("schweiz", "suisse", "switzerland")


def address_type(postal: Column, country: Column) -> Column:
    """SWISS_ADDRESS for a Swiss code or country, EU_ADDRESS for another code or country, else ADDRESS; postal and country may be null."""
    name = F.lower(F.coalesce(country, F.lit("")))
    swiss = F.coalesce(postal, F.lit("")).rlike(SWISS_CODE) | (name == "ch")
    for n in SWISS_NAMES:
        swiss = swiss | F.contains(name, F.lit(n))
    return F.when(swiss, "SWISS_ADDRESS").when(postal.isNotNull() | country.isNotNull(), "EU_ADDRESS").otherwise("ADDRESS")


def plausible_groups(entities: DataFrame) -> DataFrame:
    """entities (with grouped) without grouped Swiss and EU addresses that are longer than 100 characters, hold a # or have two blank lines or more."""
    odd = (F.length("text") > 100) | F.contains("text", F.lit("#")) | (F.regexp_count("text", F.lit("\n\n")) > 1)
    return entities.where(~(F.col("type").isin("SWISS_ADDRESS", "EU_ADDRESS") & F.coalesce("grouped", F.lit(False)) & odd))


CITY_AFTER, CITY_WITHIN = r"^[ \t]*([A-ZÄÖÜ][a-zäöüéèàâêîôûç]+(?:[ \t]+[a-zäöüéèàâêîôûç]+)?)", 50


def cities_after(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, text): the capitalised word, and a small one after it, that follows a postal code of found (doc_id, end, full) in its line, within CITY_WITHIN characters."""
    after = F.substring("full", F.col("end") + 1, F.lit(CITY_WITHIN))
    rows = found.select("doc_id", F.col("end").alias("code_end"), after.alias("after")).withColumn("text", F.regexp_extract("after", CITY_AFTER, 1)).where("text <> ''")
    start = (F.col("code_end") + F.instr("after", F.col("text")) - 1).cast("int")
    return rows.select("doc_id", start.alias("start"), (start + F.length("text")).alias("end"), "text")


NEAR_LINE, NEAR_LINES = 50, 100


def proximity_groups(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, grp, start, end, n, types) of components of found (doc_id, type, start, end): by start, one goes on with the group of the one before if it begins after its end, within
    NEAR_LINE characters, or NEAR_LINES over a line's end, and no blank line stands between; groups of LEAST or more."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    rows = found.join(docs.select("doc_id", F.col("text").alias("full")), "doc_id").withColumn("before", F.lag("end").over(w))
    gap = F.col("start") - F.col("before")
    between = F.substring("full", F.col("before") + 1, gap)
    near = gap <= F.when(between.rlike(r"[\r\n]"), NEAR_LINES).otherwise(NEAR_LINE)
    goes_on = (gap >= 0) & near & ~between.rlike(r"\n\s*\n")
    rows = rows.withColumn("grp", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "type"))), lambda s: s["type"]), ",")
    return rows.groupBy("doc_id", "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), each.alias("types")).where(F.col("n") >= LEAST)
