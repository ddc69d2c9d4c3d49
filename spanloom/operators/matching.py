"""Matching of found with expected entities, and counts over entities and components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import text_key

# What a document's type adds to the confidence of an entity's type.
TYPE_BOOSTS = {
    "INVOICE": {"AMOUNT": 0.15, "IBAN": 0.2, "VAT_NUMBER": 0.15, "PAYMENT_REF": 0.15}, "LETTER": {"PERSON": 0.1, "ADDRESS": 0.1, "DATE": 0.05}, "FORM": {"PERSON": 0.1, "DATE": 0.1},
    "CONTRACT": {"PERSON": 0.15, "ORGANIZATION": 0.15, "DATE": 0.1, "ADDRESS": 0.1}, "REPORT": {"PERSON": 0.1, "ORGANIZATION": 0.1, "DATE": 0.05}, "MEDICAL": {"SWISS_AVS": 0.25, "PERSON": 0.15, "DATE": 0.1},
    "LEGAL": {"PERSON": 0.15, "ORGANIZATION": 0.15, "ADDRESS": 0.1}, "CORRESPONDENCE": {"EMAIL": 0.1, "PHONE": 0.1, "PERSON": 0.1},
}


def match(found: DataFrame, expected: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, entity_id, expected_id, kind, overlap): a one-to-one matching in each document: first equal texts of one type, in order, then for each
    remaining find the expected entity of its type that it overlaps most, if enough. kind is exact, fuzzy or none.

    Whoever comes first takes its match, so a document's short lists are walked in Python; documents are apart.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, fs, es in zip(pdf["doc_id"], pdf["f"], pdf["e"], strict=True):
                es = list(es) if es is not None else []
                free, open_ = set(range(len(es))), []
                for f in fs if fs is not None else []:
                    hit = next((i for i in sorted(free) if es[i]["type"] == f["type"] and es[i]["key"] == f["key"]), None)
                    if hit is None:
                        open_.append(f)
                    else:
                        free.discard(hit)
                        out.append((doc, f["entity_id"], es[hit]["entity_id"], "exact", 1.0))
                for f in open_:
                    best, at = least, None
                    for i in sorted(free):
                        if es[i]["type"] != f["type"]:
                            continue
                        common = min(f["end"], es[i]["end"]) - max(f["start"], es[i]["start"])
                        ratio = max(0, common) / max(1, min(f["end"] - f["start"], es[i]["end"] - es[i]["start"]))
                        if ratio > best or (at is None and ratio >= best):
                            best, at = ratio, i
                    if at is not None:
                        free.discard(at)
                    out.append((doc, f["entity_id"], es[at]["entity_id"] if at is not None else None, "fuzzy" if at is not None else "none", round(best, 6) if at is not None else 0.0))
            yield pd.DataFrame(out, columns=["doc_id", "entity_id", "expected_id", "kind", "overlap"]).astype({"expected_id": "Int64"})

    def listed(df: DataFrame, name: str) -> DataFrame:
        rows = df.withColumn("key", text_key(F.col("text")))
        return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_id", "type", "key"))).alias(name))

    both = listed(found, "f").join(listed(expected, "e"), "doc_id", "left")
    return both.mapInPandas(walk, "doc_id long, entity_id int, expected_id int, kind string, overlap double")


def boosted_by_type(entities: DataFrame) -> DataFrame:
    """entities (with doc_type) with boosted: the confidence, raised by the document's type, at most 1."""
    rows = [(d, t, b) for d, ts in TYPE_BOOSTS.items() for t, b in ts.items()]
    table = entities.sparkSession.createDataFrame(rows, "doc_type string, type string, boost double")
    out = entities.join(F.broadcast(table), ["doc_type", "type"], "left")
    return out.withColumn("boosted", F.round(F.least(F.lit(1.0), F.col("confidence") + F.coalesce("boost", F.lit(0.0))), 6)).drop("boost")


def component_counts(components: DataFrame) -> DataFrame:
    """Of each document how many components of each type it has."""
    kinds = ["STREET_NAME", "STREET_NUMBER", "POSTAL_CODE", "CITY", "COUNTRY"]
    return components.groupBy("doc_id").pivot("type", kinds).agg(F.count("text")).select("doc_id", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in kinds])


def mapping_statistics(entities: DataFrame, least: float = 0.6) -> DataFrame:
    """(line): totals, counts by type and by source of the entities that are replaced, as Markdown."""
    chosen = entities.where(F.col("confidence") >= least)
    totals = entities.agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= least).alias("m")).select(F.explode(F.array(F.concat(F.lit("- **Total entities detected**: "), F.col("n").cast("string")), F.concat(F.lit("- **Entities anonymized**: "), F.col("m").cast("string")), F.concat(F.lit("- **Entities skipped**: "), (F.col("n") - F.col("m")).cast("string")))).alias("line"))
    by = lambda c: chosen.groupBy(c).agg(F.count("*").alias("n")).select(F.concat(F.lit("- **"), F.col(c), F.lit("**: "), F.col("n").cast("string")).alias("line"))
    return totals.unionByName(by("type")).unionByName(by("source"))
