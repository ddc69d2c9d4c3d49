"""Entity linking, pseudonyms, and rewriting of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import text_key


def link(entities: DataFrame) -> DataFrame:
    """entities with logical_id: equal keys (text_key) of one type share TYPE_n, numbered by first appearance, if they occur twice or more."""
    keyed = entities.withColumn("key", text_key(F.col("text")))
    group = Window.partitionBy("doc_id", "type", "key")
    rows = keyed.withColumns({"n": F.count("*").over(group), "first": F.min(F.struct("start", "entity_id")).over(group)})
    number = F.dense_rank().over(Window.partitionBy("doc_id", "type", F.col("n") > 1).orderBy("first"))
    return rows.withColumn("logical_id", F.when(F.col("n") > 1, F.concat_ws("_", "type", number.cast("string")))).drop("key", "n", "first")


def pseudonyms(entities: DataFrame, shared: str | None = None) -> DataFrame:
    """entities with pseudonym: each distinct text (or shared column, where it isn't null) of a type is TYPE_n, by first appearance in its document."""
    key = F.col("text") if shared is None else F.coalesce(F.col(shared), F.col("text"))
    rows = entities.withColumn("__key", key)
    rows = rows.withColumn("__first", F.min(F.struct("start", "entity_id")).over(Window.partitionBy("doc_id", "type", "__key")))
    number = F.dense_rank().over(Window.partitionBy("doc_id", "type").orderBy("__first"))
    return rows.withColumn("pseudonym", F.concat_ws("_", "type", number.cast("string"))).drop("__key", "__first")


def splice(text: Column, edits: Column) -> Column:
    """The text with (start, end, token), sorted and apart, replaced: the pieces between them, joined with the tokens."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        return F.struct(e["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["token"]).alias("out"))

    return F.aggregate(F.coalesce(edits, F.array().cast("array<struct<start:int,end:int,token:string>>")), zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def rewrite(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with rewritten: text_col with the edits (id_col, start, end, token) made, and n_entities."""
    per = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("__edits"))
    rows = docs.join(per, id_col, "left")
    return rows.withColumns({"rewritten": splice(F.col(text_col), F.col("__edits")), "n_entities": F.when(F.col("__edits").isNull(), 0).otherwise(F.size("__edits")).cast("long")}).drop("__edits")


def mapping_json(entities: DataFrame) -> DataFrame:
    """(doc_id, mapping): each document's texts and pseudonyms as a JSON object, sorted by text."""
    rows = entities.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("text", "pseudonym"))).alias("m"))
    return rows.select("doc_id", F.to_json(F.transform("m", lambda s: F.struct(s["text"].alias("original"), s["pseudonym"].alias("replacement")))).alias("mapping"))


# The names that types have in previews; others keep theirs, in capitals.
PREVIEW_TYPES = {
    "PERSON": "PERSON", "PERSON_NAME": "PERSON", "ORGANIZATION": "ORG", "ORG": "ORG", "ADDRESS": "ADDRESS", "STREET_ADDRESS": "ADDRESS", "EMAIL": "EMAIL", "PHONE": "PHONE", "DATE": "DATE", "MONEY": "MONEY",
    "IBAN": "IBAN", "SSN": "SSN", "AVS": "AVS", "PASSPORT": "PASSPORT", "LICENSE": "LICENSE", "CREDIT_CARD": "CC", "IP_ADDRESS": "IP", "URL": "URL",
}


def preview_type(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PREVIEW_TYPES.items() for x in kv])
    return F.coalesce(known[F.upper(kind)], F.upper(kind))


def preview_tokens(entities: DataFrame) -> DataFrame:
    """entities with token, [TYPE_n]: equal texts, but for case and outer space, share the token of the first by start and id, and n counts a document's texts of that one's
    preview type in the order of their first places."""
    key = F.lower(F.btrim("text"))
    rows = entities.withColumn("__key", key)
    first = rows.groupBy("doc_id", "__key").agg(F.min(F.struct("start", "entity_id")).alias("__at"), F.min_by("type", F.struct("start", "entity_id")).alias("__type"))
    first = first.withColumn("__base", preview_type(F.col("__type")))
    n = F.row_number().over(Window.partitionBy("doc_id", "__base").orderBy("__at"))
    first = first.select("doc_id", "__key", F.concat(F.lit("["), "__base", F.lit("_"), n.cast("string"), F.lit("]")).alias("token"))
    return rows.join(first, ["doc_id", "__key"]).drop("__key")


def original_offset(shown: Column, edits: Column) -> Column:
    """Where a place in the shown text stands in the original: edits is an array of (start, end, length), ascending, of what is shown instead of the original from start to end
    and how long that is. A place within an edit is the edit's start; the order of edits is that of their starts."""
    kind = "struct<dom:bigint,at:bigint,found:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("dom"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("found")).cast(kind)

    def step(acc: Column, e: Column) -> Column:
        gap = e["start"] - acc["at"]
        inside = F.when(shown < acc["dom"] + gap, acc["at"] + shown - acc["dom"]).when(shown < acc["dom"] + gap + e["length"], e["start"])
        return F.struct((acc["dom"] + gap + e["length"]).alias("dom"), e["end"].alias("at"), F.coalesce(acc["found"], inside).alias("found")).cast(kind)

    return F.aggregate(edits, start, step, lambda a: F.coalesce(a["found"], a["at"] + shown - a["dom"]))
