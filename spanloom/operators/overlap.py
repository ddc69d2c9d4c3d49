"""Overlap resolution and grouping of entities within a document: ordered folds over sorted arrays, and gap groups.

Every fold gathers one document's entities, a list that the document's length bounds, and walks it in one expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("entity_id", "start", "end", "type", "text", "confidence", "source")
#: Within a fold an entity also has the end of the span that began its run.
_KIND = "entity_id:int,start:int,end:int,type:string,text:string,confidence:double,source:string,seed:int"
ENTITY, ENTITIES = f"struct<{_KIND}>", f"array<struct<{_KIND}>>"

# The types' ranks where they compete; higher wins.
TYPE_RANK = {"IBAN": 10, "EMAIL": 8, "PHONE": 7, "ADDRESS": 5, "PERSON_NAME": 4}


def _entity(x: Column, **changed: Column) -> Column:
    return F.struct(*[changed.get(f, x[f]).alias(f) for f in (*FIELDS, "seed")])


def rank_of(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in TYPE_RANK.items() for v in kv])[kind], F.lit(0))


def folded(entities: DataFrame, order: Callable[[Column], list[Column]], step: Callable[[Column, Column, Column], Column], key: str = "doc_id") -> DataFrame:
    """Each document's entities after a fold: in the given order, step(kept so far, the last kept, entity) gives the kept ones. The first is kept."""
    rows = entities.groupBy(key).agg(F.collect_list(F.struct(*FIELDS, F.col("end").alias("seed"))).alias("all"))
    ordered = F.transform(F.array_sort(F.transform("all", lambda x: F.struct(*[c.alias(f"o{i}") for i, c in enumerate([*order(x), x["entity_id"]])], _entity(x).alias("e")))), lambda o: o["e"])
    walk = F.aggregate(ordered, F.array().cast(ENTITIES), lambda acc, x: F.when(F.size(acc) == 0, F.array(_entity(x))).otherwise(step(acc, F.element_at(acc, -1), x)))
    return rows.select(key, F.explode(walk).alias("e")).select(key, *[f"e.{f}" for f in FIELDS])


def _without_last(acc: Column) -> Column:
    return F.slice(acc, F.lit(1), F.size(acc) - 1)


def merge_sources(entities: DataFrame) -> DataFrame:
    """By start, the first of overlapping entities stays; one of another source makes it BOTH, with the higher confidence and the
    union of the bounds; one of the same source is dropped."""

    def step(acc: Column, last: Column, x: Column) -> Column:
        both = _entity(last, end=F.greatest(last["end"], x["end"]), confidence=F.greatest(last["confidence"], x["confidence"]), source=F.lit("BOTH"))
        other = (x["source"] != last["source"]) & (last["source"] != "BOTH")
        return F.when(x["start"] >= last["end"], F.array_append(acc, _entity(x))).when(other, F.array_append(_without_last(acc), both)).otherwise(acc)

    return folded(entities, lambda x: [x["start"]], step)


def final_dedup(entities: DataFrame) -> DataFrame:
    """By start, longer first: an entity that begins after the last kept one stays; an overlapping one takes its place if it is surer."""

    def step(acc: Column, last: Column, x: Column) -> Column:
        surer = x["confidence"] > last["confidence"]
        return F.when(x["start"] >= last["end"], F.array_append(acc, _entity(x))).when(surer, F.array_append(_without_last(acc), _entity(x))).otherwise(acc)

    return folded(entities, lambda x: [x["start"], x["start"] - x["end"]], step)


def priority_dedup(entities: DataFrame) -> DataFrame:
    """By start, then rank: an overlapping entity of a higher rank takes the place of the last kept one."""

    def step(acc: Column, last: Column, x: Column) -> Column:
        higher = rank_of(x["type"]) > rank_of(last["type"])
        return F.when(x["start"] >= last["end"], F.array_append(acc, _entity(x))).when(higher, F.array_append(_without_last(acc), _entity(x))).otherwise(acc)

    return folded(entities, lambda x: [x["start"], -rank_of(x["type"])], step)


def rule_dedup(entities: DataFrame) -> DataFrame:
    """In the order in which the rules found them (entity_id): an entity that overlaps none of the kept stays; one that does takes the place of
    the first it overlaps, if it is surer."""

    def step(acc: Column, last: Column, x: Column) -> Column:
        meets = F.transform(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        at = F.array_position(meets, True).cast("int")
        surer = x["confidence"] > F.get(acc, at - 1)["confidence"]
        changed = F.transform(acc, lambda k, i: F.when(i == at - 1, _entity(x)).otherwise(k))
        return F.when(at == 0, F.array_append(acc, _entity(x))).when(surer, changed).otherwise(acc)

    return folded(entities, lambda x: [x["entity_id"]], step)


def consolidate(entities: DataFrame) -> DataFrame:
    """By start, an entity and all later ones that overlap it are consumed, and their winner stays: the highest rank times
    confidence, then the longest, then the first."""

    def step(acc: Column, last: Column, x: Column) -> Column:
        worth = lambda e: rank_of(e["type"]) * e["confidence"]
        wins = (worth(x) > worth(last)) | ((worth(x) == worth(last)) & (x["end"] - x["start"] > last["end"] - last["start"]))
        return F.when(x["start"] >= last["seed"], F.array_append(acc, _entity(x))).when(wins, F.array_append(_without_last(acc), _entity(x, seed=last["seed"]))).otherwise(acc)

    return folded(entities, lambda x: [x["start"]], step)


def gap_groups(entities: DataFrame, gap: int = 50, key: str = "doc_id") -> DataFrame:
    """entities with a group number: by start, one that begins within gap characters after all before it goes on with their group."""
    w = Window.partitionBy(key).orderBy("start", "end", "entity_id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") - reach <= gap, 0).otherwise(1)
    return entities.withColumn("__new", new).withColumn("group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def grouped(entities: DataFrame, gap: int = 50, least: int = 2, least_confidence: float = 0.5) -> DataFrame:
    """Groups of least entities or more whose mean confidence suffices: bounds, number, mean, and types in order."""
    rows = gap_groups(entities, gap).groupBy("doc_id", "group")
    found = rows.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "entity_id", "type"))), lambda s: s["type"]), ",").alias("types"))
    return found.where((F.col("n") >= least) & (F.col("confidence") >= least_confidence))


def without_overlaps(entities: DataFrame, taken: DataFrame) -> DataFrame:
    """Entities that no row of taken (doc_id, start, end) overlaps: an anti join by document and range."""
    t = taken.select(F.col("doc_id").alias("td"), F.col("start").alias("ts"), F.col("end").alias("te"))
    return entities.join(t, (F.col("doc_id") == F.col("td")) & (F.col("start") < F.col("te")) & (F.col("ts") < F.col("end")), "left_anti")


def overlapping(entities: DataFrame) -> DataFrame:
    """For each entity, how many others of its document overlap it, and the least of their ids."""
    o = entities.select(F.col("doc_id").alias("od"), F.col("entity_id").alias("oe"), F.col("start").alias("os"), F.col("end").alias("oend"))
    on = (F.col("doc_id") == F.col("od")) & (F.col("entity_id") != F.col("oe")) & (F.col("start") < F.col("oend")) & (F.col("os") < F.col("end"))
    return entities.join(o, on, "left").groupBy("doc_id", "entity_id").agg(F.count("oe").alias("n"), F.min("oe").alias("least"))
