"""Matches with their offsets, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.regex import spark_regex, sql_regex

SPAN = "array<struct<start:int,end:int,text:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column, block: int = 256) -> Column:
    """What comes before each of an array of lengths, in sum. Blocks are summed by themselves and then shifted, so that long arrays aren't copied for each element."""
    kind = "struct<at:int,out:array<int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(kind)
    add = lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    def shifted(sums: Column) -> Column:
        bases = F.aggregate(sums, start, lambda a, x: add(a, x["at"]), lambda a: a["out"])
        return F.flatten(F.zip_with(sums, bases, lambda s, b: F.transform(s["out"], lambda v: v + b)))

    def blocks(own: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(own) - 1) / block)).cast("int")
        many = bound(F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(own, b * block + 1, F.lit(block)), start, add)), shifted)
        return F.when(F.size(own) <= block, F.aggregate(own, start, add, lambda a: a["out"])).otherwise(many)

    return bound(lengths, blocks)


def spans(text: Column, pattern: str, fold: bool = False, group: bool = False, any_of: tuple[str, ...] = ()) -> Column:
    """The pattern's matches, leftmost and not overlapping: an array of (start, end, text) in code points, end exclusive.

    With group, pattern has one capturing group, and the spans are the group's. Matches and the gaps between them are cut out of the text by the same
    search, so offsets are sums of lengths; a text without a match costs one search, and one that holds none of any_of, of which every match has
    one, costs none. Null text: null.
    """
    p = ("(?iu)" if fold else "") + spark_regex(pattern)
    none = F.array().cast(SPAN)

    def one(x: Column, at: Column) -> Column:
        value = x["v"] if group else x["m"]
        start = at + F.length(x["g"]) + (F.instr(x["m"], value) - 1 if group else F.lit(0))
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("text"))

    def cut(hits: Column) -> Column:
        # the text is cut only where there are hits; after the last one comes a gap more
        inner = [F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("v")] if group else []
        rows = F.arrays_zip(F.slice(F.split(text, p, -1), F.lit(1), F.size(hits)).alias("g"), hits.alias("m"), *inner)
        placed = bound(rows, lambda r: F.zip_with(r, running(F.transform(r, lambda x: F.length(x["g"]) + F.length(x["m"]))), one))
        return F.when(F.size(hits) == 0, none).otherwise(placed.cast(SPAN))

    found = bound(F.regexp_extract_all(text, F.lit(p), F.lit(0)), cut)
    if any_of:
        there = F.contains(text, F.lit(any_of[0]))
        for x in any_of[1:]:
            there = there | F.contains(text, F.lit(x))
        return F.when(there, found).when(text.isNotNull(), none)
    return F.when(text.isNotNull(), found)


def spans_sql(source: str, key: str, text: str, pattern: str, fold: bool = False, group: bool = False) -> str:
    """SQL for (key, start, end, text) of the same matches in source, for the comparison engine."""
    p = sql_regex(pattern)[1:-1]
    flags = "(?is)" if fold else "(?s)"
    part = lambda n: f"regexp_extract_all({text}, '{flags}(.*?)({p})', {n})"
    return f"""(select {key}, (b + {"instr(m, v) - 1" if group else "0"})::int as start, (b + {"instr(m, v) - 1" if group else "0"} + length(v))::int as "end", v as text from (
  select {key}, unnest(ms) as m, unnest(vs) as v, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) as b
  from (select {key}, {part(1)} as gs, {part(2)} as ms, {part(3 if group else 2)} as vs from {source})))"""
