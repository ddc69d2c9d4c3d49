"""Confidence: context factors, position, repetition, boosts, thresholds and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types that speak for each other, and the weights of the factors.
RELATED = {"PERSON_NAME": ("PHONE", "EMAIL", "ADDRESS", "DATE"), "ADDRESS": ("PERSON", "ORGANIZATION", "PHONE"), "IBAN": ("PERSON", "ORGANIZATION", "AMOUNT"), "PHONE": ("PERSON", "ORGANIZATION", "ADDRESS", "EMAIL"), "EMAIL": ("PERSON", "ORGANIZATION", "PHONE")}
WEIGHTS = {"label": 0.25, "related": 0.3, "position": 0.15, "repetition": 0.2}
# Words that announce a type.
LABELS = {
    "PERSON_NAME": ["name", "nom", "vorname", "nachname", "herr", "frau", "mr", "mrs", "ms", "dr", "prof", "monsieur", "madame"],
    "ORGANIZATION": ["firma", "company", "société", "gmbh", "ag", "sa", "sàrl", "ltd", "inc", "corp"],
    "ADDRESS": ["adresse", "address", "anschrift", "wohnort", "domicile", "strasse", "rue", "street"],
    "SWISS_ADDRESS": ["adresse", "address", "anschrift", "wohnort", "domicile", "ch-", "schweiz", "suisse"],
    "EU_ADDRESS": ["adresse", "address", "anschrift", "deutschland", "france", "österreich"],
    "SWISS_AVS": ["avs", "ahv", "sozialversicherung", "assurance", "versicherungsnummer", "numéro avs"],
    "IBAN": ["iban", "konto", "compte", "account", "bankverbindung", "coordonnées bancaires"],
    "PHONE": ["tel", "telefon", "téléphone", "phone", "mobile", "handy", "natel", "portable", "fax"],
    "EMAIL": ["email", "e-mail", "mail", "courriel", "elektronisch"],
    "DATE": ["datum", "date", "geboren", "geburtsdatum", "né", "naissance", "born", "birthday"],
    "VAT_NUMBER": ["mwst", "tva", "iva", "vat", "ust", "uid", "steuer"],
    "PAYMENT_REF": ["referenz", "référence", "reference", "zahlungsreferenz", "qr"],
}
EDGE_TYPES = ("SWISS_AVS", "IBAN", "PAYMENT_REF")
REVIEW_BELOW = 0.6


def label_factor(found: DataFrame, window: int = 50) -> DataFrame:
    """found (with the column full, the whole text) with labelled: whether a word of the type stands in the characters before the span."""
    before = F.lower(F.substring("full", F.greatest(F.lit(1), F.col("start") - window + 1), F.least(F.lit(window), F.col("start"))))
    arm = None
    for kind, words in LABELS.items():
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(before, w))
        arm = F.when(F.col("type") == kind, hit) if arm is None else arm.when(F.col("type") == kind, hit)
    return found.withColumn("labelled", arm.otherwise(F.lit(False)))


def related_factor(entities: DataFrame, near: int = 50) -> DataFrame:
    """entities with related: whether one of a related type stands within near characters, edge to edge: a semi join by document and range."""
    o = entities.select(F.col("doc_id").alias("od"), F.col("entity_id").alias("oe"), F.col("type").alias("ot"), F.col("start").alias("os"), F.col("end").alias("oend"))
    types = F.create_map(*[x for k, v in RELATED.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    gap = F.greatest(F.col("os") - F.col("end"), F.col("start") - F.col("oend"), F.lit(0))
    on = (F.col("doc_id") == F.col("od")) & (F.col("entity_id") != F.col("oe")) & (gap <= near) & F.array_contains(types[F.col("type")], F.col("ot"))
    hits = entities.join(o, on, "left_semi").select("doc_id", "entity_id", F.lit(True).alias("related"))
    return entities.join(hits, ["doc_id", "entity_id"], "left").withColumn("related", F.coalesce("related", F.lit(False)))


def position_factor(start: Column, kind: Column, length: Column, edge: float = 0.1) -> Column:
    """False for identifiers in the first or last tenth of the text, else true."""
    return ~(kind.isin(*EDGE_TYPES) & ((start < length * edge) | (start > length * (1 - edge))))


def repetition_factor() -> Column:
    return F.count("*").over(Window.partitionBy("doc_id", "type", "text")) > 1


def combined(confidence: Column, **matched: Column) -> Column:
    """The confidence, weighed by the share of the factors' weights that matched: from 0.7 to 1.3 times, at most 1."""
    score = sum((F.when(m, F.lit(WEIGHTS[k])).otherwise(F.lit(0.0)) for k, m in matched.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return F.round(F.least(F.lit(1.0), confidence * (0.7 + 0.6 * score)), 6)


def zone(start: Column, length: Column, header: float = 0.2, footer: float = 0.8) -> Column:
    return F.when(start < length * header, "header").when(start > length * footer, "footer").otherwise("body")


# What a document's type and an entity's zone add to its confidence.
ZONE_DELTAS = {("LETTER", "PERSON_NAME", "header"): 0.15, ("LETTER", "PERSON_NAME", "footer"): 0.2, ("LETTER", "ADDRESS", "header"): 0.2, ("INVOICE", "IBAN", "footer"): 0.15, ("INVOICE", "ADDRESS", "header"): 0.15, ("INVOICE", "EMAIL", "header"): 0.1}


def adjusted_by_zone(entities: DataFrame) -> DataFrame:
    """entities (with length and doc_type) with zone and the confidence after the zone's change: a join with a small table."""
    spark = entities.sparkSession
    deltas = spark.createDataFrame([(*k, v) for k, v in ZONE_DELTAS.items()], "doc_type string, type string, zone string, delta double")
    rows = entities.withColumn("zone", zone(F.col("start"), F.col("length"))).join(F.broadcast(deltas), ["doc_type", "type", "zone"], "left")
    return rows.withColumn("adjusted", F.round(F.least(F.lit(1.0), F.col("confidence") + F.coalesce("delta", F.lit(0.0))), 6)).drop("delta")


def classified(confidence: Column, least: float = 0.3, flag: float = 0.6, auto: float = 0.85) -> Column:
    return F.when(confidence < least, "drop").when(confidence < flag, "review").when(confidence >= auto, "auto").otherwise("keep")


def boosted_by_region(entities: DataFrame, regions: DataFrame, boost: float = 0.2) -> DataFrame:
    """entities with the confidence raised inside the first region (doc_id, region, lo, hi) that holds them: a containment join, first match wins."""
    r = regions.select(F.col("doc_id").alias("rd"), "region", "lo", "hi")
    hits = entities.join(r, (F.col("doc_id") == F.col("rd")) & (F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi")))
    first = hits.groupBy("doc_id", "entity_id").agg(F.min("region").alias("region"))
    return entities.join(first, ["doc_id", "entity_id"], "left").withColumn("boosted", F.round(F.when(F.col("region").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.col("confidence")), 6))
