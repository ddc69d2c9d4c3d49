"""Queries of rules, recognisers, layout, review and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import detector_validators as detector
from spanloom.functions import repair
from spanloom.functions import validators as v
from spanloom.functions.regex import sql_regex
from spanloom.operators import address, analytics, layout, matching, overlap, review, rules
from spanloom.operators.extract import DETECTOR, HIGH_RECALL, Pattern, extract, extract_sql
from spanloom.plans import analytics as analytics_plans
from spanloom.plans import texts as texts_plans
from spanloom.plans.inputs import ENTITIES_SQL, TEXTS_SQL, derived, entities, in_sql, table, texts
from spanloom.sources import sinks
from spanloom.streaming import streams

E, T = f"e as {ENTITIES_SQL}", f"t as materialized {TEXTS_SQL}"

AMOUNTS = """select c_custkey as doc_id, case c_custkey % 5 when 0 then 'CHF 1''234.' || lpad(cast(c_custkey % 100 as string), 2, '0') when 1 then '1.' || lpad(cast(c_custkey % 1000 as string), 3, '0') || ',56 EUR'
  when 2 then 'USD 1,' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '.5' when 3 then cast(c_custkey as string) || ' £' else 'nothing' end as text from {customer}"""
ACTIONS = """select l_orderkey as doc_id, cast(l_linenumber as int) as entity_id, l_partkey * 10000 + l_suppkey * 10 + l_linenumber as ts, case l_partkey % 3 when 0 then 'approved' when 1 then 'rejected' else 'edited' end as status from {lineitem} where l_suppkey % 2 = 0"""
ITEMS = """select l_orderkey as page_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as item_id, 'w' || cast(l_partkey % 90 as string) as str,
  cast(l_suppkey % 4 * 60 as double) as x, cast(700 - l_partkey % 3 * 20 as double) as y, cast(10 + l_partkey % 45 as double) as width from {lineitem}"""
FILES = """select o_orderkey as id, case o_orderkey % 7 when 0 then 'failed' when 1 then 'pending' when 2 then 'processing' when 3 then 'cancelled' else 'completed' end as status, o_custkey * 7919 as size,
  case o_orderkey % 3 when 0 then 'Timeout after 5 s' when 1 then 'bad zip' else 'Network down' end as message, cast(o_orderkey % 5 as int) as attempt, case o_orderkey % 4 when 0 then 'de-CH' when 1 then 'fr_FR' when 2 then 'EN' else 'es' end as locale from {orders}"""


def x4_invoice(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_entities(texts(spark, d), rules.INVOICE).select("doc_id", "type", "pattern", "start", "text", "confidence")


def x6_letter(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_entities(texts(spark, d), rules.LETTER).select("doc_id", "type", "pattern", "start", "text", "confidence")


def _rules_sql(patterns: tuple[Pattern, ...]) -> str:
    return f"with {T}, f as {extract_sql('t', patterns)} select f.doc_id, type, pattern, start, f.text, round(least(1.0, 0.85 + case when start < length(t.text) * 0.2 then 0.2 else 0 end), 4)::double as confidence from f join t using (doc_id)"


def x5_amounts(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d, AMOUNTS).select("doc_id", rules.amount_of(F.col("text")).alias("a")).select("doc_id", "a.currency", "a.value")


_X5 = f"""with a as (select doc_id, text, trim(regexp_replace(text, '[^\\d.,''\\s]', '', 'g')) as r from {in_sql(AMOUNTS)}),
n as (select *, case when contains(r, '''') then replace(replace(r, '''', ''), ',', '.') when regexp_matches(r, '\\d+\\.\\d{{3}},\\d{{2}}$') then replace(replace(r, '.', ''), ',', '.') else regexp_replace(r, '[,\\s]', '', 'g') end as z from a)
select doc_id, case when regexp_matches(lower(text), 'chf|sfr') then 'CHF' when regexp_matches(lower(text), 'eur|€') then 'EUR' when regexp_matches(lower(text), 'usd|\\$') then 'USD' when regexp_matches(lower(text), 'gbp|£') then 'GBP' else 'UNKNOWN' end as currency,
  try_cast(regexp_extract(trim(z), '^(\\d+(?:\\.\\d+)?|\\.\\d+)', 1) as double) as value from n"""

def v13_deny_list(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").unionByName(texts(spark, d), allowMissingColumns=True).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zäöüé]{2,}"), F.lit(0))).alias("text")).distinct()
    return rules.not_denied(words.withColumn("type", F.lit("PERSON_NAME"))).select("text")


_DENIED = ", ".join("'" + w + "'" for w in rules.DENIED)


def x16_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """All occurrences of "an" but the marked first one."""
    t = texts(spark, d)
    marked = t.where(F.contains("text", F.lit("an"))).select("doc_id", F.lit("WORD").alias("type"), F.lit("an").alias("text"), (F.instr("text", "an") - 1).alias("start"), (F.instr("text", "an") + 1).alias("end"))
    return rules.expand_occurrences(marked, t)


def o15_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    t = texts(spark, d)
    mapping = extract(t, HIGH_RECALL[2:3]).select("doc_id", F.col("text").alias("original"), F.lit("EMAIL_1").alias("token")).distinct()
    return rules.fuzzy_replace(t, mapping)


def p15_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.lines_of(derived(spark, d, ITEMS))


_P15 = f"""with i as {in_sql(ITEMS)}, l as (select *, sum(case when prev - y <= 5 then 0 else 1 end) over (partition by page_id order by y desc, x, item_id rows unbounded preceding)::int as line from (select *, lag(y) over (partition by page_id order by y desc, x, item_id) as prev from i)),
g as (select *, x - lag(x + width) over (partition by page_id, line order by x, item_id) as gap from l) select page_id, line, string_agg(case when gap > 2 then ' ' else '' end || str, '' order by x, item_id) as text from g group by all"""


def p17_headings(spark: SparkSession, d: str) -> DataFrame:
    return layout.headings(table(spark, d, "documents").select("doc_id", F.concat(F.lit("1. Introduction to it\n\nBIG WORDS HERE\n\nAnna Muster\n\n"), "text").alias("text")))


_P17 = f"""with l as (select doc_id, unnest(string_split(t, chr(10))) as raw, unnest(range(len(string_split(t, chr(10)))))::int as position from (select doc_id, '1. Introduction to it' || chr(10) || chr(10) || 'BIG WORDS HERE' || chr(10) || chr(10) || 'Anna Muster' || chr(10) || chr(10) || text as t from documents)),
k as (select doc_id, position, trim(raw) as line, coalesce(lead(trim(raw)) over (partition by doc_id order by position), '') as after from l)
select doc_id, position, line from k where length(line) between 10 and 100 and after = '' and not regexp_matches(line, {sql_regex(r"@|\+?\d{2,}[ .-]?\d{2,}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|^[-=_*]{3,}$|^\d{4,5} +[A-Z]|^[A-Z][a-zà-ÿ]+ +[A-Z][a-zà-ÿ]+( +[A-Z][a-zà-ÿ]+)?$")})
  and ((line = upper(line) and regexp_matches(line, '[A-Z]') and len(regexp_split_to_array(line, '\\s+')) >= 2) or regexp_matches(line, '^\\d+(?:\\.\\d+)*\\.?\\s+[A-Z]'))"""


def x17_tables(spark: SparkSession, d: str) -> DataFrame:
    return layout.detect_tables(derived(spark, d, ITEMS))


def a16b_review(spark: SparkSession, d: str) -> DataFrame:
    return review.review_result(review.decided(entities(spark, d), derived(spark, d, ACTIONS)))


_A16B = f"""with {E}, a as {in_sql(ACTIONS)}, l as (select doc_id, entity_id, max_by(status, ts) as status from a group by all), r as (select e.*, coalesce(status, 'pending') as status from e left join l on e.doc_id = l.doc_id and e.entity_id = l.entity_id)
select doc_id, count(*) filter (status in ('approved', 'edited')) as approved, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'pending') as pending, coalesce(string_agg(distinct text, '|' order by text) filter (status in ('approved', 'edited')), '') as texts from r group by doc_id"""


def a16c_manual(spark: SparkSession, d: str) -> DataFrame:
    return review.manual_replacements(entities(spark, d)).select("doc_id", "entity_id", "replacement")


def v17_filters(spark: SparkSession, d: str) -> DataFrame:
    return review.visible(entities(spark, d), ["EMAIL", "PHONE"], True, 0.2, "MUSTER").select("doc_id", "entity_id", "type")


def j13_detectors(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d)
    return review.merge_detectors(rows.where("source = 'RULE'"), rows.where("source = 'ML'")).select("doc_id", "entity_id", "source", "confidence")


_J13 = f"""with {E}, r as (select * from e where source = 'RULE'), m as (select * from e where source = 'ML'), b as (select r.doc_id, r.entity_id, max(m.confidence) as mc from r join m on r.doc_id = m.doc_id and r.start < m."end" and m.start < r."end" group by all)
select r.doc_id, r.entity_id, case when mc is not null then 'BOTH' else source end as source, round(case when mc is not null then least(1.0, greatest(mc, confidence) * 1.1) else confidence end, 6) as confidence from r left join b on r.doc_id = b.doc_id and r.entity_id = b.entity_id
union all select doc_id, entity_id, source, confidence from m where not exists (select 1 from r where r.doc_id = m.doc_id and m.start < r."end" and r.start < m."end")"""


def v19_overlap(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("doc_id", "entity_id", review.overlap_ratio(F.col("start"), F.col("end"), F.lit(40), F.lit(90)).alias("ratio"))


def v14_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    t = texts(spark, d).select("doc_id", F.concat(F.lit("---\nsource: a@mail.example.com\n---\n"), "text").alias("text"))
    found = extract(t, HIGH_RECALL[2:3]).join(t.select("doc_id", F.col("text").alias("full")), "doc_id")
    return review.without_frontmatter(found, F.col("full")).select("doc_id", "start", "text")


def a17_batch(spark: SparkSession, d: str) -> DataFrame:
    return review.batch_states(derived(spark, d, FILES))


def t4_retries(spark: SparkSession, d: str) -> DataFrame:
    rows = derived(spark, d, FILES)
    return rows.select("id", review.retry_delay(F.col("attempt"), F.col("message")).alias("delay"), review.timeout_ms(F.col("size")).alias("timeout"), review.readable_size(F.col("size")).alias("size"), review.ui_language(F.col("locale")).alias("language"))


def a15_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d)
    return review.failures(analytics.precision_recall(rows.where("source = 'ML'"), rows.where("source = 'RULE'"), ["doc_id", "type", "text"]), 0.2, 0.15)


def p27_warnings(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("�"))).when(F.col("doc_id") % 4 == 2, F.lit("\x01\x02a")).otherwise(F.col("text")).alias("text"))
    return t.select("doc_id", review.input_warnings(F.col("text")).alias("warnings"))


def k3_mapping_table(spark: SparkSession, d: str) -> DataFrame:
    """Original texts with type and count, as lines of a Markdown table."""
    rows = entities(spark, d).groupBy("type", "text").agg(F.count("*").alias("n"))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", "text", "type", F.col("n").cast("string")), F.lit(" |")).alias("line"))


def p14_repair(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", repair.split_merged(F.concat(F.lit("8085Zurich,Softcom TechnologiesSA l'eau Tél.direct +41216274137 www. x. ch a @ b  "), "text")).alias("text"))


def p26_markdown(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", repair.heading(c, (F.col("doc_id") % 9).cast("int")).alias("heading"), repair.quoted(c).alias("quote"), repair.looks_like_code(F.concat(F.when(F.col("doc_id") % 2 == 0, "let a = 1").otherwise(""), c)).alias("code"), repair.ending(F.concat(F.lit("A."), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, ".MD").otherwise(""))).alias("ending"))


def j11_matching(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d)
    return matching.match(rows.where("source = 'ML'"), rows.where("source = 'RULE'"))


def c10_type_boosts(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).withColumn("doc_type", F.element_at(F.array(*[F.lit(k) for k in matching.TYPE_BOOSTS]), (F.col("doc_id") % len(matching.TYPE_BOOSTS) + 1).cast("int")))
    return matching.boosted_by_type(rows).select("doc_id", "entity_id", "doc_type", "boosted")


_KINDS = "[" + ", ".join(f"'{k}'" for k in matching.TYPE_BOOSTS) + "]"
_BOOSTS = " ".join(f"when doc_type = '{d}' and type = '{t}' then {b}" for d, ts in matching.TYPE_BOOSTS.items() for t, b in ts.items())


def a19_components(spark: SparkSession, d: str) -> DataFrame:
    return matching.component_counts(address.components(texts(spark, d)))


def k4_statistics(spark: SparkSession, d: str) -> DataFrame:
    return matching.mapping_statistics(entities(spark, d))


def a20_denied(spark: SparkSession, d: str) -> DataFrame:
    """By type, how many high-recall entities the deny list drops."""
    found = extract(texts(spark, d), HIGH_RECALL).withColumn("text", F.when(F.length("text") % 5 == 0, "Total").otherwise(F.col("text")))
    kept = rules.not_denied(found, patterns={}).groupBy("type").agg(F.count("*").alias("kept"))
    return found.groupBy("type").agg(F.count("*").alias("n")).join(kept, "type", "left").select("type", "n", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("denied"))


_A19 = ", ".join(f"count(*) filter (type = '{k}') as {k.lower()}" for k in ("STREET_NAME", "STREET_NUMBER", "POSTAL_CODE", "CITY", "COUNTRY"))
_MERGED_IN = "'8085Zurich,Softcom TechnologiesSA l''eau Tél.direct +41216274137 www. x. ch a @ b  ' || text"
IBANS = """select c_custkey as doc_id, case c_custkey % 3 when 0 then 'CH' || lpad(cast(c_custkey % 97 as string), 2, '0') || '00762011623852957' when 1 then 'XX' || lpad(cast(c_custkey % 97 as string), 2, '0') || '12345678901' else 'GB' || lpad(cast(c_custkey % 97 as string), 2, '0') || ' WEST 1234 5698 7654 32' end as text,
  case c_custkey % 4 when 0 then 'Rue de la Gare ' || cast(c_custkey as string) when 1 then 'Postfach ' || cast(c_custkey as string) when 2 then 'Weg 1' else 'Bahnhofstrasse 12b ' end as street,
  case c_custkey % 5 when 0 then 'Anna Muster' when 1 then 'Rue Basse' when 2 then 'ABC Meier' when 3 then 'Zoe' else 'AB Jean Luc' end as person, cast(c_custkey % 33 as string) || '.' || cast(c_custkey % 14 as string) || '.' || cast(1890 + c_custkey as string) as day from {customer}"""


def v2_v10_detector(spark: SparkSession, d: str) -> DataFrame:
    """The detector's and the invoice rules' validators on derived identifiers."""
    rows = derived(spark, d, IBANS)
    return rows.select("doc_id", detector.iban(F.col("text")).alias("iban"), detector.invoice_iban(F.col("text")).alias("invoice_iban"), detector.street(F.col("street")).alias("street"), detector.person(F.col("person")).alias("person"), detector.date(F.col("day")).alias("date"))


_DLEN = "map {" + ", ".join(f"'{k}': {n}" for k, n in detector.LENGTHS.items()) + "}"
_COMMON = ", ".join(f"'{w}'" for w in detector.COMMON)
_V2 = f"""with i as (select *, upper(replace(regexp_replace(text, '\\s', '', 'g'), '-', '')) as code, regexp_split_to_array(trim(person), '\\s+') as parts, string_split(day, '.') as p from {in_sql(IBANS)}),
n as (select *, array_to_string(list_transform(string_split(substr(code, 5) || left(code, 4), ''), lambda ch: case when ascii(ch) >= 65 then (ascii(ch) - 55)::varchar else ch end), '') as num from i),
m as (select *, ((left(num, 30)::hugeint % 97)::varchar || substr(num, 31))::hugeint % 97 as rest from n)
select doc_id, coalesce(length(code) = {_DLEN}[left(code, 2)], false) and rest = 1 as iban, length(code) between 15 and 34 and rest = 1 as invoice_iban,
  length(street) >= 5 and regexp_matches(street, '\\d+[A-Za-z]?\\s*$') and length(trim(regexp_replace(street, '\\s+\\d+[A-Za-z]?\\s*$', ''))) >= 5 and not regexp_matches(lower(street), 'case postale|postfach|p\\.o\\. box|boîte postale') as street,
  length(person) >= 3 and len(parts) >= 2 and len(list_filter(parts, lambda x: lower(x) in ({_COMMON}) or (x = upper(x) and length(x) > 2))) = 0 as person,
  len(p) = 3 and try_cast(p[1] as int) between 1 and 31 and try_cast(p[2] as int) between 1 and 12 and try_cast(p[3] as int) between 1900 and 2100 as date from m"""


def t1_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events, streamed into a log by month, and then counted by month and type."""
    out = streams.work_dir(spark, "log")
    events = streams.read_files(spark, d, table(spark, d, "events").schema, names="events.parquet")
    streams.log_stream(events, f"{out}/rows", f"{out}/checkpoint")
    return sinks.read_log(spark, f"{out}/rows").groupBy(F.col("month").cast("string").alias("month"), "event_type").agg(F.count("*").alias("n"))


_ENTITY = "select doc_id, entity_id"
QUERIES = {
    "a15_failures": (a15_failures, f"with {analytics_plans._PR}, f as (select type, array_to_string(list_filter([case when precision < 0.2 then 'precision' end, case when recall < 0.15 then 'recall' end], lambda x: x is not null), ',') as failed from (select *, {analytics_plans._RATES} from p)) select type, failed from f where failed <> ''"),
    "a16b_review": (a16b_review, _A16B),
    "a16c_manual": (a16c_manual, f"with {E} {_ENTITY}, type || '_MANUAL_' || row_number() over (partition by doc_id, type order by start, entity_id) as replacement from e"),
    "a19_components": (a19_components, f"select doc_id, {_A19} from ({texts_plans.QUERIES['x7_address_components'][1]}) group by doc_id"),
    "a20_denied": (a20_denied, f"with {T}, f as (select type, case when length(text) % 5 = 0 then 'Total' else text end as text from {extract_sql('t', HIGH_RECALL)}) select type, count(*) as n, count(*) filter (lower(trim(text)) in ({_DENIED})) as denied from f group by type"),
    "c10_type_boosts": (c10_type_boosts, f"with {E}, k as (select *, {_KINDS}[doc_id % {len(matching.TYPE_BOOSTS)} + 1] as doc_type from e) select doc_id, entity_id, doc_type, round(least(1.0, confidence + case {_BOOSTS} else 0 end), 6)::double as boosted from k"),
    "j11_matching": (j11_matching, None),
    "k4_statistics": (k4_statistics, f"with {E}, c as (select * from e where confidence >= 0.6) select '- **Total entities detected**: ' || count(*) as line from e union all select '- **Entities anonymized**: ' || count(*) from c union all select '- **Entities skipped**: ' || count(*) filter (confidence < 0.6) from e union all select '- **' || type || '**: ' || count(*) from c group by type union all select '- **' || source || '**: ' || count(*) from c group by source"),
    "p14_repair": (p14_repair, f"with {T} select doc_id, {repair.split_merged_sql(_MERGED_IN)} as text from t"),
    "p26_markdown": (p26_markdown, f"with c as (select *, text as s from documents) select doc_id, repeat('#', greatest(1, least(6, doc_id % 9))::int) || ' ' || s || chr(10) || chr(10) as heading, array_to_string(list_transform(string_split(s, chr(10)), lambda x: '> ' || x), chr(10)) || chr(10) || chr(10) as quote, {repair.looks_like_code_sql("(case when doc_id % 2 = 0 then 'let a = 1' else '' end || s)")} as code, case when doc_id % 3 = 0 then '.md' else '.' || lang end as ending from c"),
    "a17_batch": (a17_batch, f"with f as {in_sql(FILES)} select count(*) as total, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("pending", "processing", "completed", "failed", "cancelled")) + ", round(100 * count(*) filter (status in ('completed', 'failed', 'cancelled')) / count(*), 2) as percent from f"),
    "j13_detectors": (j13_detectors, _J13),
    "k3_mapping_table": (k3_mapping_table, f"with {E} select '| ' || text || ' | ' || type || ' | ' || count(*) || ' |' as line from e group by type, text"),
    "o15_fuzzy": (o15_fuzzy, None),
    "p15_lines": (p15_lines, _P15),
    "p17_headings": (p17_headings, _P17),
    "p27_warnings": (p27_warnings, "select doc_id, case doc_id % 4 when 0 then 'empty' when 1 then 'replacement characters' when 2 then 'control characters' else '' end as warnings from documents"),
    "t1_log_stream": (t1_log_stream, "select strftime(ts, '%Y-%m') as month, event_type, count(*) as n from events group by 1, 2"),
    "t4_retries": (t4_retries, f"with f as {in_sql(FILES)} select id, case when attempt between 1 and 3 and regexp_matches(message, '(?i)timeout|network') then (100 * power(2, attempt - 1))::int end as delay, greatest(10000, least(600000, 30000 + ceil(size / 1048576) * 10000))::int as timeout, case when size < 1024 then size || ' B' when size < 1048576 then format('{{:.1f}} KB', size / 1024) else format('{{:.1f}} MB', size / 1048576) end as size, case lower(left(locale, 2)) when 'de' then 'de' when 'fr' then 'fr' else 'en' end as language from f"),
    "v13_deny_list": (v13_deny_list, f"with {T}, w as (select distinct unnest(regexp_extract_all(text, '[A-Za-zäöüé]{{2,}}')) as text from (select text from documents union all select text from t)) select text from w where not {rules.is_denied_sql("'PERSON_NAME'", 'text')}"),
    "v14_frontmatter": (v14_frontmatter, f"with {T}, m as (select doc_id, '---' || chr(10) || 'source: a@mail.example.com' || chr(10) || '---' || chr(10) || text as text from t) select doc_id, start, text from {extract_sql('m', HIGH_RECALL[2:3])} where start >= 35"),
    "v17_filters": (v17_filters, f"with {E} {_ENTITY}, type from e where type in ('EMAIL', 'PHONE') and confidence < 0.6 and confidence >= 0.2 and contains(lower(text), 'muster')"),
    "v19_overlap": (v19_overlap, f"with {E} {_ENTITY}, round(greatest(0, least(\"end\", 90) - greatest(start, 40)) / least(\"end\" - start, 50), 6)::double as ratio from e"),
    "v2_v10_detector": (v2_v10_detector, _V2),
    "x4_invoice": (x4_invoice, _rules_sql(rules.INVOICE)),
    "x5_amounts": (x5_amounts, _X5),
    "x6_letter": (x6_letter, _rules_sql(rules.LETTER)),
    "x16_occurrences": (x16_occurrences, f"with {T}, p as (select doc_id, text as full_text, unnest(range(1, length(text)))::int as i from t) select doc_id, 'WORD' as type, 'an' as text, i - 1 as start, i + 1 as \"end\" from p where substr(full_text, i, 2) = 'an' and i <> instr(full_text, 'an')"),
    "x17_tables": (x17_tables, None),
}
