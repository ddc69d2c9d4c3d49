"""Benchmark decontamination by winnowing.

Both sides keep the least hash of every window of k-grams; equal hashes make a document a candidate for an item, and
the candidate's hits are then extended over its whole text. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import bound
from spanloom.llm.common import ascii_lower, bounded, exploded, free_name, row_key, settled, table

#: Words of a window; a document word inside a shared window is a hit.
SPAN = 13
#: Words of a k-gram. Any shared window of SPAN words has SPAN - K + 1 of them, one of which is the least.
K = 6
#: A document is contaminated if it has hits and SHARE * hits >= words.
SHARE = 20
#: Rows of one or two hashes up to which a table is broadcast; beyond, the join shuffles.
MOST_BROADCAST = 500_000

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def _grams(words: str, k: str) -> str:
    """SQL for the hashes of all runs of k words."""
    return f"if(size({words}) >= {k}, transform(sequence(1, size({words}) - {k} + 1), i -> xxhash64(slice({words}, i, {k}))), array())"


def _beside(values: Column, step: int, both) -> Column:
    """both(x, y) of each two values that are step apart."""
    n = F.greatest(F.lit(0), F.size(values) - step)
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(step + 1), n), both)


def _steps(width: int) -> list[int]:
    """By how much runs of one place are to grow, again and again, to runs of width places: doubling, and what is left."""
    out, have = [], 1
    while have < width:
        out.append(min(have, width - have))
        have += out[-1]
    return out


def fingerprints(words: Column, k: int, window: int) -> Column:
    """The distinct least hashes of every window of k-grams of words. Hashes of runs, and then least ones, grow by doubling, so a word takes a few steps, whatever k and
    window; each step's array is bound to a name, so that it is worked out once and the plan stays small."""
    todo = [(s, lambda x, y: F.xxhash64(x, y)) for s in _steps(k)] + [(s, lambda x, y: F.least(x, y)) for s in _steps(window)]

    def grown(values: Column, i: int) -> Column:
        return F.array_distinct(values) if i == len(todo) else bound(values, lambda v: grown(_beside(v, *todo[i]), i + 1))

    return grown(F.transform(words, lambda x: F.xxhash64(x)), 0)


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(item_id, len, words, windows): hashes of the item's windows, which are all of len words; items without words have no row."""
    rows = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    rows = rows.withColumn("len", F.least(F.lit(span), F.size("words")))
    return rows.select("item_id", "len", "words", F.expr(f"array_distinct({_grams('words', 'len')})").alias("windows"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """docs with n_words, n_hit, n_items (long), items (array of item ids as strings, sorted) and contaminated.

    Candidates come from fingerprints. An item with span words or more shares a whole window with a document only if
    they share a winnowed k-gram; a shorter one, its own only window, is looked up as it is, by the runs of its length. So no shared
    window is missed, and short items make no more documents candidates than hold them. Candidates' texts are then searched whole, window by
    window. Null and empty texts have no words, no hits and aren't contaminated; items without words are in no document. Rows of one item id
    are one item; repeated documents each get their own row. Tables without rows give no rows or no hits. Further columns stay, but those
    named here are replaced, as is __key.
    """
    keyed = docs.drop("n_words", "n_hit", "n_items", "items", "contaminated").withColumn("__key", row_key(id_col, text_col))
    found = measured(keyed, items, text_col, item_col, item_text, span)
    out = keyed.join(bounded(found, MOST_BROADCAST // 10), "__key", "left")
    out = out.withColumns({"n_words": F.size(words_of(F.col(text_col))).cast("long"), "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>")), "contaminated": F.coalesce("contaminated", F.lit(False))})
    return out.withColumn("n_items", F.size("items").cast("long")).drop("__key")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """docs without the contaminated ones, as contamination() tells them; columns stay as they are."""
    key = row_key(id_col, text_col)
    bad = measured(docs.select(key.alias("__key"), text_col), items, text_col, item_col, item_text, span).where("contaminated").select("__key")
    own = free_name(docs, "__own")
    keyed = docs.select("*", key.alias(own))
    return keyed.join(bounded(bad, MOST_BROADCAST), keyed[own] == bad["__key"], "left_anti").select(docs.columns)


def measured(keyed: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text: str, span: int = SPAN) -> DataFrame:
    """(__key, n_hit, items, contaminated) of the documents with hits, from rows with a __key; a table in the shared folder.
    Only the texts of candidates are searched, and only they are shuffled, if at all. Windows and items meet by equal hashes; what a
    document has of an item is never gathered but as places and ids."""
    bench = settled(benchmark_windows(items, item_col, item_text, span), "benchmark")
    lengths = sorted(r[0] for r in bench.select("len").distinct().limit(span).collect())
    if not lengths:
        return keyed.sparkSession.createDataFrame([], "__key struct<a:long,b:long>, n_hit long, items array<string>, contaminated boolean")
    windows = settled(exploded(bench, F.col("windows"), "g", "item_id", "len").distinct(), "windows")
    sought = settled(windows.select("len", "g").distinct(), "sought")
    k = min(K, span)
    texts = keyed.select("__key", words_of(F.col(text_col)).alias("words"))
    found = []
    if span in lengths:
        prints = fingerprints(F.col("words"), k, span - k + 1)
        longs = bench.where(F.col("len") == span).select(F.explode(prints).alias("fp")).distinct()
        found.append(exploded(texts, prints, "fp", "__key").join(bounded(settled(longs, "fingerprints"), MOST_BROADCAST), "fp", "left_semi"))
    for n in (x for x in lengths if x < span):
        short = sought.where(F.col("len") == n).select("g")
        found.append(exploded(texts, F.array_distinct(F.expr(_grams("words", str(n)))), "g", "__key").join(bounded(short, MOST_BROADCAST), "g", "left_semi"))
    candidates = None
    for rows in found:
        rows = rows.select("__key").distinct()
        candidates = rows if candidates is None else candidates.union(rows)
    candidates = settled(candidates.distinct(), "candidates")
    some = keyed.select("__key", F.col(text_col).alias("__text")).join(bounded(candidates, MOST_BROADCAST), "__key", "left_semi").dropDuplicates(["__key"])
    some = settled(some.select("__key", words_of(F.col("__text")).alias("words")), "words")
    hits = None
    for n in lengths:
        # an outer generator, as in exploded()
        rows = some.select("__key", F.size("words").alias("n"), F.lit(n).alias("len"), F.posexplode_outer(F.expr(_grams("words", str(n)))).alias("at", "g")).where("g is not null")
        hits = rows if hits is None else hits.union(rows)
    hits = settled(hits.join(bounded(sought, MOST_BROADCAST), ["len", "g"], "left_semi"), "hits")
    covered = "aggregate(array_sort(starts), named_struct('to', 0, 'n', 0L), (a, x) -> named_struct('to', greatest(a.to, x.e), 'n', a.n + greatest(0, x.e - greatest(a.to, x.s))), a -> a.n)"
    starts = F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + F.col("len")).alias("e")))
    per_doc = hits.groupBy("__key").agg(F.max("n").alias("n"), starts.alias("starts")).select("__key", "n", F.expr(covered).alias("n_hit"))
    names = hits.select("__key", "len", "g").distinct().join(windows, ["len", "g"]).select("__key", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    names = names.distinct().groupBy("__key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = per_doc.join(names, "__key").select("__key", "n_hit", "items", (F.col("n_hit") * SHARE >= F.col("n")).alias("contaminated"))
    return settled(out, "contaminated")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, hits and items against the whole benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from
  (select item_id, w, least({SPAN}, len(w)) as n, unnest(range(1, len(w) - least({SPAN}, len(w)) + 2)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
hit as (select doc_id, i, n, item_id from dw join bw using (n, g)),
pos as (select doc_id, count(distinct p) as h from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by doc_id),
it as (select doc_id, count(distinct item_id) as k, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as s from hit group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(h, 0)::bigint as n_hit, coalesce(k, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(h, 0) > 0 and {SHARE} * coalesce(h, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join it using (doc_id)"""
