"""Queries on texts, documents' types, addresses, tokens and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as t
from spanloom.functions.regex import sql_regex
from spanloom.operators import address, tokens
from spanloom.operators.extract import extract_sql
from spanloom.plans.inputs import IDS_SQL, TEXTS_SQL, derived, ids, in_sql, table, texts
from spanloom.sources import markup

T = f"t as materialized {TEXTS_SQL}"
TOKENS = """select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as token_id,
  case l_suppkey % 4 when 0 then 'O' when 1 then 'B-PER' when 2 then 'I-PER' else 'I-LOC' end as tag, 'w' || cast(l_suppkey % 9 as string) as word, cast(l_linenumber * 9 as int) as start, cast(l_linenumber * 9 + 4 + l_partkey % 5 as int) as {end}, cast(l_quantity as double) / 50 as score from {lineitem}"""
TOKENS_SPARK, TOKENS_SQL = TOKENS.replace("{end}", "end"), in_sql(TOKENS.replace("{end}", '"end"'))


def _of_texts(**columns):
    return lambda spark, d: texts(spark, d).select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()])


def _of_documents(**columns):
    return lambda spark, d: table(spark, d, "documents").select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()])


def p1_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", t.normalise_unicode(F.col("text")).alias("n"))
    return rows.select("doc_id", F.col("n.text").alias("text"), F.size("n.index_map").alias("places"))


def p7_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """The lemmas of the documents' distinct words, in three languages, and how often each word stands."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüßàâéèêëîïôùûç]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", "n", *[t.lemma(F.col("word"), lang).alias(lang) for lang in t.LEMMA_RULES])


def p20_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of the ids' e-mail addresses, and of the documents' whole texts, of which long ones have none."""
    rows = ids(spark, d).select("doc_id", F.col("email").alias("text")).unionByName(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", t.fuzzy_pattern(F.col("text")).alias("pattern"))


def p8_cities(spark: SparkSession, d: str) -> DataFrame:
    return ids(spark, d).select("doc_id", t.city_key(F.substring("address", 5, 50)).alias("city"), t.postal_key(F.concat(F.lit("ch-"), F.substring("address", 1, 4))).alias("postal"))


def p25_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.preview(F.col("text"), 3, 200).alias("preview"))


def p23_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.text_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


def c16_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").unionByName(texts(spark, d))
    return docs.select("doc_id", t.language(F.col("text")).alias("language"))


def x7_address_components(spark: SparkSession, d: str) -> DataFrame:
    return address.components(texts(spark, d))


_C = [p for p in address.COMPONENTS if p.type != "STREET_NUMBER"]
_NUMBER = address.COMPONENTS[2]


def _x7_sql() -> str:
    from spanloom.functions.spans import spans_sql

    return f"""with {T}, f as materialized (select doc_id, type, start, "end", text from {extract_sql("t", tuple(_C))}),
n as (select doc_id, 'STREET_NUMBER' as type, start, "end", text from {spans_sql("t", "doc_id", "text", _NUMBER.regex)})
select * from f union all select * from n where exists (select 1 from f where f.type = 'STREET_NAME' and f.doc_id = n.doc_id and least(abs(n.start - f."end"), abs(n.start - f.start)) <= 50)"""


def o7_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Linked address groups with pattern, confidence and score."""
    rows = texts(spark, d)
    groups = address.link_components(address.components(rows), rows)
    pattern = address.pattern_of(F.col("types"))
    return groups.select("doc_id", "start", "end", F.array_join("types", ",").alias("types"), pattern.alias("pattern"), address.confidence_of(pattern, F.col("types")).alias("confidence"), address.score_of(pattern, F.col("types"), F.col("texts")).alias("score"))


#: Groups of types, for the pattern and scores on their own.
GROUPS = """select c_custkey as doc_id, case c_custkey % 6 when 0 then 'STREET_NAME,STREET_NUMBER,POSTAL_CODE,CITY' when 1 then 'POSTAL_CODE,CITY,STREET_NAME' when 2 then 'STREET_NAME,POSTAL_CODE,CITY,COUNTRY' when 3 then 'POSTAL_CODE,CITY' when 4 then 'STREET_NUMBER,STREET_NAME' else 'STREET_NUMBER,CITY' end as types from {customer}"""


def c13_address_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, GROUPS).withColumn("a", F.split("types", ","))
    pattern = address.pattern_of(F.col("a"))
    return rows.select("doc_id", pattern.alias("pattern"), address.confidence_of(pattern, F.col("a")).alias("confidence"))


_HAS = lambda k: f"list_contains(a, '{k}')"
_C13 = f"""with g as (select doc_id, string_split(types, ',') as a from {in_sql(GROUPS)}),
p as (select *, case when {_HAS("STREET_NAME")} and {_HAS("POSTAL_CODE")} and {_HAS("CITY")} then case when {_HAS("COUNTRY")} then 'EU' when list_position(a, 'STREET_NAME') < list_position(a, 'POSTAL_CODE') then 'SWISS' else 'ALTERNATIVE' end
  when (({_HAS("STREET_NAME")} or {_HAS("STREET_NUMBER")}) and ({_HAS("POSTAL_CODE")} or {_HAS("CITY")})) or ({_HAS("POSTAL_CODE")} and {_HAS("CITY")}) then 'PARTIAL' else 'NONE' end as pattern from g)
select doc_id, pattern, round(least(1.0, case pattern when 'SWISS' then 0.85 when 'EU' then 0.85 when 'ALTERNATIVE' then 0.75 when 'PARTIAL' then 0.5 else 0.3 end + greatest(0, len(a) - 2) * 0.02
  + case when {_HAS("STREET_NAME")} and {_HAS("STREET_NUMBER")} then 0.05 else 0 end + case when {_HAS("POSTAL_CODE")} and {_HAS("CITY")} then 0.05 else 0 end), 6)::double as confidence from p"""


def j10_cantons(spark: SparkSession, d: str) -> DataFrame:
    """The cantons of the ids' postal codes: a join of codes with ranges."""
    ranges = spark.createDataFrame(address.CANTONS, "low int, high int, canton string")
    rows = ids(spark, d).select("doc_id", F.substring("address", 1, 4).try_cast("int").alias("code"))
    return rows.join(F.broadcast(ranges), F.col("code").between(F.col("low"), F.col("high")), "left").select("doc_id", "code", "canton")


_RANGES = ", ".join(f"({a}, {b}, '{c}')" for a, b, c in address.CANTONS)


def x15_merge_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.merge_tokens(derived(spark, d, TOKENS_SPARK))


def x15b_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    return tokens.merge_runs(derived(spark, d, TOKENS_SPARK))


_ISLANDS = """k as (select *, regexp_replace(tag, '^[BI]-', '') as type, starts_with(tag, 'I-') as inn from tok where tag <> 'O'),
l as (select *, lag(type) over w as lt, lag("end") over w as le from k window w as (partition by doc_id order by start, token_id)),
i as (select *, sum(case when {cond} then 0 else 1 end) over (partition by doc_id order by start, token_id rows unbounded preceding) as ent from l)"""


def x14_merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, TOKENS_SPARK).select("doc_id", F.lit("P").alias("type"), (F.col("start") % 30).alias("start"), (F.col("start") % 30 + F.col("end") - F.col("start") + 5).alias("end"), "score")
    return tokens.merge_chunks(rows)


_X14 = f"""with tok as {TOKENS_SQL}, r as (select doc_id, 'P' as type, start % 30 as start, start % 30 + "end" - start + 5 as "end", score from tok),
l as (select doc_id, list({{'start': start, 'end': "end", 'type': type, 'score': score}} order by start, "end", type, score) as xs from r group by doc_id),
k as (select doc_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, y: case when acc[-1].type = y[1].type and (least(acc[-1]."end", y[1]."end") - y[1].start) * 2 > least(acc[-1]."end" - acc[-1].start, y[1]."end" - y[1].start)
  then list_concat(acc[:-2], [{{'start': acc[-1].start, 'end': greatest(acc[-1]."end", y[1]."end"), 'type': acc[-1].type, 'score': greatest(acc[-1].score, y[1].score)}}]) else list_concat(acc, y) end)) as e from l)
select doc_id, e.type as type, e.start as start, e."end" as "end", e.score as score from k"""


def x13_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tokens.chunks(table(spark, d, "documents"))


def x12_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of a stand-in model (words in capitals) over the chunks, merged."""
    return tokens.merge_chunks(tokens.predictions(tokens.chunks(table(spark, d, "documents")), capitals_model))


def capitals_model():
    """A deterministic stand-in for a recogniser: runs of two capitals or more are organisations."""
    import re

    found = re.compile(r"(?<![A-Za-z])[A-Z]{2,}(?![a-z])")
    return lambda texts: [[("ORG", m.start(), m.end(), 0.9) for m in found.finditer(x)] for x in texts]


def s4_pages(spark: SparkSession, d: str) -> DataFrame:
    return markup.html_to_markdown(table(spark, d, "pages"), "page_id", "html")


def s1_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", markup.with_frontmatter(F.col("text"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.lit("txt")).alias("markdown"))


def s2_csv(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit(' a , "x, ""y""",'), F.col("avs"), F.lit(" ,, "), F.col("address"))
    return ids(spark, d).select("doc_id", F.array_join(markup.csv_cells(line), "|").alias("cells"))


def p18_code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their code taken out: fenced blocks, then inline code."""
    rows = texts(spark, d).select("doc_id", F.concat("text", F.lit("\n```py\nx = 1\n```\nand `y` end")).alias("text"))
    return rows.select("doc_id", F.regexp_replace(F.regexp_replace("text", "(?s)```.*?```", "<CODE>"), "`[^`\n]+`", "<INLINE>").alias("text"))


_REVEAL = "text"
for _p, _s in t.EMAIL_SIGNS:
    _REVEAL = f"regexp_replace({_REVEAL}, {sql_regex(_p, fold=True)}, '{_s}', 'g')"
_REVEAL = f"regexp_replace({_REVEAL}, {sql_regex(r'(\+\d{1,3})\s*\(0\)\s*')}, '\\1 ', 'g')"
_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
_HEAD = "array_to_string(string_split(text, chr(10))[1:3], chr(10))"

QUERIES = {
    "p1_normalise": (p1_normalise, None),
    "p2_spaces": (_of_documents(text=lambda c: t.normalise_spaces(F.concat(c, F.lit("a\u00a0b\u200bc\u202fd")))), "select doc_id, text || 'a b' || 'c d' as text from documents"),
    "p3_reveal": (_of_texts(text=lambda c: t.reveal_phones(t.reveal_emails(c))), f"with {T} select doc_id, {_REVEAL} as text from t"),
    "p6_text_key": (_of_documents(key=t.text_key), f"select doc_id, trim(regexp_replace(lower(text), {sql_regex(r'\s+')}, ' ', 'g')) as key from documents"),
    "p7_lemmas": (p7_lemmas, f"with w as (select unnest(regexp_extract_all(lower(text), '[a-zäöüßàâéèêëîïôùûç]+')) as word from documents) select word, count(*) as n, {', '.join(f'{t.lemma_sql(chr(119) + chr(111) + chr(114) + chr(100), x)} as {x}' for x in t.LEMMA_RULES)} from w group by word"),
    "p8_cities": (p8_cities, f"select doc_id, replace(translate(trim(lower(substr(address, 5))), 'äàâéèêëîïìöôòüùûç', 'aaaeeeeiiiooouuuc'), 'ß', 'ss') as city, regexp_replace(left(address, 4), '\\s', '', 'g') as postal from {IDS_SQL}"),
    "p11_tokens": (_of_documents(tokens=t.token_estimate), f"select doc_id, greatest(ceil(length(text) / 4.0)::int, {_WORDS})::int as tokens from documents"),
    "p18_code_blocks": (p18_code_blocks, f"with {T} select doc_id, text || chr(10) || '<CODE>' || chr(10) || 'and <INLINE> end' as text from t"),
    "p20_fuzzy": (p20_fuzzy, f"with k as (select doc_id, text, regexp_replace(text, '[^\\w]', '', 'g') as c from (select doc_id, email as text from {IDS_SQL} union all select doc_id, text from documents)) select doc_id, case when length(text) <= 50 and length(c) between 3 and 30 then array_to_string(string_split(c, ''), '[^a-zA-Z0-9]{{0,2}}?') end as pattern from k"),
    "p21_clean_log": (_of_texts(text=t.clean_log), f"with {T} select doc_id, {t.clean_log_sql('text')} as text from t"),
    "p23_counts": (p23_counts, f"select doc_id, (len(string_split(text, chr(10))) - case when ends_with(text, chr(10)) or text = '' then 1 else 0 end)::int as lines, {_WORDS}::int as words, length(text)::int as chars from documents"),
    "p25_preview": (p25_preview, f"select doc_id, case when length({_HEAD}) > 200 or length({_HEAD}) < length(text) then left({_HEAD}, 200) || chr(10) || '[...]' else {_HEAD} end as preview from documents"),
    "s7_strip_markdown": (_of_texts(text=lambda c: t.strip_markdown(F.concat(F.lit("# Head\n**bold** and _it_ `c` [l](u)\n- one\n1. two\n> q\n\n\n\n| a | b |\n|---|---|\n"), c))), f"with {T} select doc_id, {t.strip_markdown_sql(chr(39) + '# Head' + chr(39) + ' || chr(10) || ' + chr(39) + '**bold** and _it_ `c` [l](u)' + chr(39) + ' || chr(10) || ' + chr(39) + '- one' + chr(39) + ' || chr(10) || ' + chr(39) + '1. two' + chr(39) + ' || chr(10) || ' + chr(39) + '> q' + chr(39) + ' || chr(10) || chr(10) || chr(10) || chr(10) || ' + chr(39) + '| a | b |' + chr(39) + ' || chr(10) || ' + chr(39) + '|---|---|' + chr(39) + ' || chr(10) || text')} as text from t"),
    "c16_language": (c16_language, f"with {T} select doc_id, {t.language_sql('text')} as language from (select doc_id, text from documents union all select * from t)"),
    "x7_address_components": (x7_address_components, _x7_sql()),
    "o7_addresses": (o7_addresses, None),
    "c13_address_confidence": (c13_address_confidence, _C13),
    "j10_cantons": (j10_cantons, f"select doc_id, try_cast(left(address, 4) as int) as code, canton from {IDS_SQL} left join (values {_RANGES}) r(low, high, canton) on try_cast(left(address, 4) as int) between low and high"),
    "x12_predictions": (x12_predictions, None),
    "x13_chunks": (x13_chunks, None),
    "x13_sentences": (lambda spark, d: tokens.sentences(table(spark, d, "documents")), None),
    "x14_merge_chunks": (x14_merge_chunks, _X14),
    "x15_merge_tokens": (x15_merge_tokens, f"with tok as {TOKENS_SQL}, {_ISLANDS.format(cond='inn and lt = type and start - le <= 5')} select doc_id, type, min(start) as start, max(\"end\") as \"end\", count(*) as n, round(avg(score), 6) as score, string_agg(word, ' ' order by start, token_id) as text from i group by doc_id, ent, type"),
    "x15b_merge_runs": (x15b_merge_runs, f"with tok as {TOKENS_SQL}, {_ISLANDS.format(cond='lt = type')} select doc_id, type, min(start) as start, max(\"end\") as \"end\", count(*) as n from i group by doc_id, ent, type"),
    "s1_frontmatter": (s1_frontmatter, f"with {T} select doc_id, '---' || chr(10) || 'source: doc' || doc_id || chr(10) || 'format: txt' || chr(10) || '---' || chr(10) || chr(10) || case when regexp_matches(text, '(?m)^#{{1,6}}\\s') or contains(text, '```') then '' else '# doc' || doc_id || chr(10) || chr(10) end || text as markdown from t"),
    "s2_csv": (s2_csv, f"select doc_id, 'a|x, \"y\"|' || avs || '||' || trim(address) as cells from {IDS_SQL}"),
    "s4_pages": (s4_pages, None),
}
