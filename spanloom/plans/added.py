"""Queries of context words, recognisers, repair, page layouts, bordered tables, previews and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import detector_validators as detector
from spanloom.functions import repair
from spanloom.functions import text as t
from spanloom.functions import validators as v
from spanloom.functions.regex import sql_regex
from spanloom.operators import address, analytics, classify, context, extract, grid, layout, linking, overlap, rules, tokens
from spanloom.plans import analytics as plans_analytics
from spanloom.plans import detection
from spanloom.plans import entities as plans_entities
from spanloom.plans import texts as plans_texts
from spanloom.plans.inputs import ENTITIES_SQL, IDS_SQL, TEXTS_SQL, dealt_texts, derived, entities, ids, in_sql, table, texts

E, T = f"e as {ENTITIES_SQL}", f"t as materialized {TEXTS_SQL}"
RUNTIME = ("Rechnung", "Tél", "Contact")
#: Items of pages: a few left edges and heights with small shifts, words, numbers and what letters hold.
ITEMS = """select l_orderkey as page_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as item_id,
  case l_partkey % 9 when 0 then '1''234.50' when 1 then 'Date: 01.02.2024' when 2 then 'Madame, Monsieur' when 3 then 'Réf 12' when 4 then '77 %' else 'w' || cast(l_partkey % 90 as string) end as str,
  cast(l_suppkey % 4 * 90 + l_partkey % 3 as double) as x, cast(700 - l_partkey % 4 * 20 - l_suppkey % 2 as double) as y, cast(10 + l_partkey % 45 as double) as width,
  case l_partkey % 2 when 0 then 'Arial-Bold' else 'Arial' end as font from {lineitem}"""
#: Pages of many items each, for layouts.
PAGES = ITEMS.replace("l_orderkey as page_id", "l_orderkey % 40 as page_id").replace("partition by l_orderkey order by", "partition by l_orderkey % 40 order by l_orderkey,").replace("l_suppkey % 4 * 90", "case when l_suppkey % 5 = 0 then 0 else 120 + l_suppkey % 4 * 90 end")
TABLES = """select l_orderkey % 500 as doc_id, cast(l_orderkey as int) as table_id, cast(l_partkey % 2 as int) as kind, count(*) as n, cast(min(l_suppkey) as double) as x, cast(min(l_linenumber) as double) as y, cast(max(l_suppkey) as double) as x2, cast(max(l_partkey) as double) as y2, cast(sum(l_quantity) as double) / 1000 as confidence from {lineitem} group by 1, 2, 3"""


def _lang(df: DataFrame) -> DataFrame:
    return df.withColumn("lang", t.language(F.col("full")))


def _found(docs: DataFrame) -> DataFrame:
    rows = _lang(docs.withColumn("full", F.col("text")))
    return extract.extract(rows, extract.HIGH_RECALL, keep=("full", "lang")).withColumn("confidence", F.lit(0.5))


def c9_enhanced(spark: SparkSession, d: str) -> DataFrame:
    """High-recall entities with the words of their type and the text's language; denied ones keep their confidence."""
    return context.enhance(_found(dealt_texts(spark, d)), denied=rules.is_denied(F.col("type"), F.col("text"))).select("doc_id", "pattern", "start", "enhanced")


def c8_runtime(spark: SparkSession, d: str) -> DataFrame:
    """The same with words that are given at run time, and regions with words of their own."""
    regions = texts(spark, d).where("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("from"), F.lit(60).alias("to"), F.array(F.lit("Muster")).alias("words"))
    return context.enhance(_found(texts(spark, d)), runtime=RUNTIME, regions=regions).select("doc_id", "pattern", "start", "enhanced")


_CTX = f"""select row_number() over () as k, f.*, t.text as "full", {t.language_sql("t.text")} as lang, 0.5::double as confidence from {extract.extract_sql("t", extract.HIGH_RECALL)} f join t using (doc_id)"""


def _c9_sql(value: str, runtime: tuple[str, ...] = (), regions: bool = False) -> str:
    inner = context.enhance_sql("select * from ctx", runtime)
    if regions:
        inner = inner.replace("p as (select c.k", "l2 as (select * from l union all select k, 'muster', 'muster', 0.8, 1 from ctx where doc_id % 2 = 0 and start >= 0 and \"end\" <= 60), p as (select c.k", 1).replace("from c join l using (k)", "from c join l2 using (k)", 1)
    return f"with {T}, ctx as materialized ({_CTX}) select doc_id, pattern, start, {value} as enhanced from ({inner})"


_C9 = _c9_sql(f"case when {rules.is_denied_sql('type', 'text')} then confidence else enhanced end")
_C8 = _c9_sql("enhanced", RUNTIME, True)


def j6_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).withColumn("column", F.element_at(F.array(F.lit("Mail"), F.lit("NAME"), F.lit("x")), (F.col("entity_id") % 3 + 1).cast("int")))
    hints = spark.createDataFrame([("mail", "email", 0.9), ("Name", "PERSON_NAME", None), ("X", "IBAN", -1.0)], "column string, type string, boost double")
    return context.column_boost(rows, hints).select("doc_id", "entity_id", "boosted")


AVS = rules.Recognizer("swiss_avs", ((extract.Pattern("SWISS_AVS", "dots", r"\b756\.\d{4}\.\d{4}\.\d{2}\b"), 0.7), (extract.Pattern("SWISS_AVS", "plain", r"\b756\d{10}\b"), 0.6)), ("CH",), priority=10, specificity=5, validator=v.swiss_avs)
MAIL = rules.Recognizer("email", ((extract.Pattern("EMAIL", "email", r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"), 0.8),), priority=5, specificity=1, deny=("x@mail1.ch",))
NAME = rules.Recognizer("name", ((extract.Pattern("PERSON_NAME", "capital", r"\b(?:Anna|Jean|Marie|Total) [a-z]+\b"), 0.5),), deny_patterns=("^Marie",), weak=True, global_deny=True)
PLATE = {"name": "plate", "type": "LICENSE_PLATE", "regex": r"\bTI\s?\d{1,6}\b", "score": 0.9, "countries": ["CH"]}


def x10_registry(spark: SparkSession, d: str) -> DataFrame:
    """Three recognisers and one of a configuration over the texts."""
    r = rules.Registry()
    for known in (AVS, MAIL, NAME):
        r.register(known)
    r.load([PLATE, {"name": "bad", "type": "X", "regex": "(", "score": 0.1}, {"name": "odd", "type": "X", "regex": "x", "score": 3}])
    return r.analyze(texts(spark, d), ("CH",), low_types=("LICENSE_PLATE",)).select("doc_id", "recognizer", "start", "text", "score")


_X10_PATTERNS = tuple(extract.Pattern(p.type, p.name, p.regex, True) for r in (AVS, MAIL, NAME) for p, _ in r.patterns) + (extract.Pattern("LICENSE_PLATE", "plate", PLATE["regex"], True),)
_AVS_OK = f"length(text) <= 20 and length(dg) = 13 and starts_with(dg, '756') and try_cast(substr(dg, 13, 1) as int) = (10 - ({detection._sum([1, 3] * 6).replace('substr(d,', 'substr(dg,')}) % 10) % 10"
_X10 = f"""with {T}, f as (select *, regexp_replace(text, '[^0-9]', '', 'g') as dg from {extract.extract_sql("t", _X10_PATTERNS)})
select doc_id, case rank when 2 then 'email' when 3 then 'name' when 4 then 'plate' else 'swiss_avs' end as recognizer, start, text, [0.7, 0.6, 0.8, 0.2, 0.36][rank + 1]::double as score from f
where case when rank < 2 then {_AVS_OK} when rank = 2 then lower(trim(text)) <> 'x@mail1.ch' when rank = 3 then not regexp_matches(text, '^Marie') and not {rules.is_denied_sql("type", "text")} else true end"""


def v12_registry(spark: SparkSession, d: str) -> DataFrame:
    """The ids' identifiers, checked by a registry of three validators; a later one of equal priority doesn't count, and dates have none."""
    known = v.ValidatorRegistry()
    known.register("AVS", v.swiss_avs, 1)
    known.register("AVS", v.email, 1)
    known.register("EMAIL", v.email)
    known.register("POSTAL", v.email)
    known.register("POSTAL", v.postal_code, 2)
    known.freeze()
    rows = None
    for kind, column in (("AVS", F.col("avs")), ("EMAIL", F.col("email")), ("POSTAL", F.substring("address", 1, 4)), ("DATE", F.col("date"))):
        one = ids(spark, d).select("doc_id", F.lit(kind).alias("type"), column.alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("doc_id", "type", "text", known.check(F.col("type"), F.col("text")).alias("r")).select("doc_id", "type", "text", "r.valid", "r.confidence")


_V12 = " union all ".join(f"select doc_id, '{k}' as type, text, valid, confidence from ({sql})" for k, sql in (("AVS", detection._AVS_SQL), ("EMAIL", detection._EMAIL_SQL), ("POSTAL", detection._POSTAL_SQL))) + f" union all select doc_id, 'DATE', date, null, null from {IDS_SQL}"


def p7_title_key(spark: SparkSession, d: str) -> DataFrame:
    title = F.element_at(F.array(*[F.lit(x) for x in ("Dr. Herr  ", "mme ", "Prof. dr ", "", "Herrmann ", "MR. ")]), (F.col("entity_id") % 6 + 1).cast("int"))
    return entities(spark, d).select("doc_id", "entity_id", t.title_key(F.concat(title, "text")).alias("key"))


_P7 = f"""with {E}, k as (select doc_id, entity_id, trim(regexp_replace(lower(['Dr. Herr  ', 'mme ', 'Prof. dr ', '', 'Herrmann ', 'MR. '][entity_id % 6 + 1] || text), {sql_regex(r"\s+")}, ' ', 'g')) as key from e)
select doc_id, entity_id, {t.title_key_sql("key")} as key from k"""
_TORN = "mes dames et mes  sie urs, compl èt e l ' eau qu ’ il infor mation le ment  fi ni un ab cd ef "


def p13_joined(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", repair.join_broken(F.concat(F.lit(_TORN), F.coalesce("text", F.lit("")))).alias("text"))


def _p13_sql() -> str:
    out = f"select doc_id, '{_TORN.replace(chr(39), chr(39) * 2)}' || coalesce(text, '') as text from documents"
    for step in repair.join_broken_sql("text"):
        out = f"select doc_id, {step} as text from ({out})"
    return out


def p16_layouts(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_layouts(derived(spark, d, PAGES))


_HAS = lambda p: f"bool_or(regexp_matches(str, {sql_regex(p.replace('(?i)', ''), fold=True)}))"
_P16 = f"""with i as materialized {in_sql(PAGES)}, p as (select page_id, count(*) as n, min(x) as low, max(x) as high, {_HAS(layout.DATED)} as dated, {_HAS(layout.REFERRED)} as referred, {_HAS(layout.SALUTED)} as saluted from i group by page_id),
g as (select page_id, floor(x / 10 + 0.5) * 10 as edge, count(*) as m, min(item_id) as first from i join p using (page_id) where high - low >= 200 and floor(x / 10 + 0.5) * 10 > low + 50 group by all),
m as (select page_id, edge from (select *, row_number() over (partition by page_id order by m desc, first) as r from g) where r = 1),
r as (select p.*, case when high - low >= 200 then coalesce(edge, low) - 20 end as split from p left join m using (page_id)),
q as (select r.*, (select count(*) from i where i.page_id = r.page_id and x < low + (high - low) * 0.25) as quarter, (select count(*) from i where i.page_id = r.page_id and x < split) as side from r),
z as (select *, high - low >= 200 and side >= 5 and n - side >= 5 as two from q)
select page_id, n >= 20 and high - low >= 200 and quarter / n > 0.1 and quarter / n < 0.35 and (dated or referred) and saluted as letter, case when two then 2 else 1 end as columns, case when two then split end as split from z"""


def p16b_raw(spark: SparkSession, d: str) -> DataFrame:
    return layout.raw_text(derived(spark, d, ITEMS))


_P16B = f"""with i as {in_sql(ITEMS)}, l as (select *, lag(y) over (partition by page_id order by item_id) as b from i)
select page_id, string_agg(case when b is null then '' when b <> y then chr(10) else ' ' end || str, '' order by item_id) as text from l group by page_id"""


def p19_escaped(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", t.regex_escaped(F.concat("text", F.lit("[a](b)\\ {c}^$|?*+"))).alias("pattern"))


def t6_guarded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", t.guarded(F.col("text"), r"\b\d{3}\b", 2000).alias("g"))
    return rows.select("doc_id", "g.success", "g.value", "g.error")


def v16_groups(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("SWISS_ADDRESS"), F.lit("EU_ADDRESS"), F.lit("ADDRESS")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = texts(spark, d).select("doc_id", kind.alias("type"), (F.col("doc_id") % 5 > 0).alias("grouped"), F.concat(F.substring("text", 1, (70 + F.col("doc_id") % 50).cast("int")), F.when(F.col("doc_id") % 7 == 0, "\n\nx\n\ny").otherwise("")).alias("text"))
    return address.plausible_groups(rows.withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.substring("text", 1, 60)).otherwise(F.col("text")))).select("doc_id", "type")


_V16 = f"""with {T}, r as (select doc_id, ['SWISS_ADDRESS', 'EU_ADDRESS', 'ADDRESS'][doc_id % 3 + 1] as type, doc_id % 5 > 0 as grouped, left(text, 70 + doc_id % 50) || case when doc_id % 7 = 0 then chr(10) || chr(10) || 'x' || chr(10) || chr(10) || 'y' else '' end as s from t),
k as (select *, case when doc_id % 11 = 0 then left(s, 60) else s end as text from r)
select doc_id, type from k where not (type <> 'ADDRESS' and grouped and (length(text) > 100 or contains(text, '#') or len(regexp_extract_all(text, '\\n\\n')) > 1))"""


def o10_types(spark: SparkSession, d: str) -> DataFrame:
    postal = F.when(F.col("doc_id") % 3 > 0, F.regexp_extract("address", r"^\d+", 0))
    country = F.element_at(F.array(F.lit("Schweiz"), F.lit(None), F.lit("France"), F.lit("CH")), (F.col("doc_id") % 4 + 1).cast("int"))
    return ids(spark, d).select("doc_id", address.address_type(postal, country).alias("type"))


_O10 = f"""with i as (select doc_id, case when doc_id % 3 > 0 then regexp_extract(address, '^\\d+') end as postal, ['Schweiz', null, 'France', 'CH'][doc_id % 4 + 1] as country from {IDS_SQL})
select doc_id, case when regexp_matches(coalesce(postal, ''), '^[1-9]\\d{{3}}$') or lower(coalesce(country, '')) in ('ch', 'schweiz') then 'SWISS_ADDRESS' when postal is not null or country is not null then 'EU_ADDRESS' else 'ADDRESS' end as type from i"""
_CODE = extract.Pattern("POSTAL_CODE", "code", r"\b[1-9]\d{3}\b")


def j8_cities(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d)
    return address.cities_after(extract.extract(rows, (_CODE,)).join(rows.select("doc_id", F.col("text").alias("full")), "doc_id"))


_CITY = "regexp_extract(a, '" + address.CITY_AFTER + "', 1)"
_J8 = f"""with {T}, f as (select doc_id, f."end" as e, substr(t.text, f."end" + 1, 50) as a from {extract.extract_sql("t", (_CODE,))} f join t using (doc_id))
select doc_id, (e + instr(a, {_CITY}) - 1)::int as start, (e + instr(a, {_CITY}) - 1 + length({_CITY}))::int as "end", {_CITY} as text from f where {_CITY} <> ''"""


def o6_proximity(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d)
    return address.proximity_groups(address.components(rows), rows)


_O6 = f"""with {T}, c as (select doc_id, type, start, "end" from ({plans_texts.QUERIES["x7_address_components"][1]})),
b as (select c.*, t.text as full_text, lag("end") over (partition by c.doc_id order by start, "end", type) as before from c join t using (doc_id)),
m as (select *, start - before as gap, substr(full_text, before + 1, start - before) as s from b),
g as (select *, sum(case when gap >= 0 and gap <= case when regexp_matches(s, '[\\r\\n]') then 100 else 50 end and not regexp_matches(s, '\\n\\s*\\n') then 0 else 1 end) over (partition by doc_id order by start, "end", type rows unbounded preceding)::int as grp from m)
select doc_id, grp, min(start) as start, max("end") as "end", count(*) as n, string_agg(type, ',' order by start, "end", type) as types from g group by doc_id, grp having count(*) >= 2"""


def o13c_preview(spark: SparkSession, d: str) -> DataFrame:
    return linking.preview_tokens(entities(spark, d)).select("doc_id", "entity_id", "token")


_BASE = "case upper(type) " + " ".join(f"when '{k}' then '{x}'" for k, x in linking.PREVIEW_TYPES.items()) + " else upper(type) end"
_O13C = f"""with {E}, f as (select doc_id, lower(trim(text)) as key, min((start, entity_id)) as first_at, arg_min({_BASE}, (start, entity_id)) as base from e group by all),
n as (select doc_id, key, '[' || base || '_' || row_number() over (partition by doc_id, base order by first_at) || ']' as token from f)
select e.doc_id, entity_id, token from e join n on e.doc_id = n.doc_id and lower(trim(e.text)) = n.key"""


def o16_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Places 0, 25 and 70 of each shown text, in the original; every kept entity is shown as a token of nine signs."""
    kept = entities(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_id"))).alias("all"))
    apart = F.filter("all", lambda x, i: (i == 0) | (x["start"] >= F.get(F.col("all"), i - 1)["end"]))
    # the filter looks at neighbours, so what it leaves may still overlap; those are left out as well
    edits = F.transform(F.slice(apart, 1, 1), lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), F.lit(9).cast("long").alias("length")))
    return kept.select("doc_id", *[linking.original_offset(F.lit(n).cast("long"), edits).alias(f"at_{n}") for n in (0, 25, 70)])


_AT = lambda n: f"case when {n} < s then {n} when {n} < s + 9 then s else z + {n} - s - 9 end::bigint as at_{n}"
_O16 = f"""with {E}, f as (select doc_id, start as s, "end" as z from (select *, row_number() over (partition by doc_id order by start, "end", entity_id) as r from e) where r = 1) select doc_id, {_AT(0)}, {_AT(25)}, {_AT(70)} from f"""


def x13_token_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 512 tokens of whole sentences; their texts as digests."""
    rows = tokens.sentence_chunks(table(spark, d, "documents"))
    return rows.select("doc_id", "chunk", "start", "end", F.md5("text").alias("digest"))


def x17_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.grid_lines(derived(spark, d, ITEMS))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",")
    return rows.select("page_id", shown("ys").alias("ys"), shown("xs").alias("xs"))


def _fit(axis: str, near: float, order: str) -> str:
    at = f"list_position(list_transform(acc, lambda k: abs(k.at - y[1].at) <= {near}), true)"
    return f"""select page_id, list_sort(list_transform(list_filter(list_reduce(list_transform(list({axis} order by item_id), lambda v: [{{'at': v, 'n': 1}}]),
  lambda acc, y: case when coalesce({at}, 0) = 0 then list_concat(acc, y) else list_concat(list_concat(acc[1:{at} - 1], [{{'at': acc[{at}].at, 'n': acc[{at}].n + 1}}]), acc[{at} + 1:len(acc)]) end), lambda k: k.n >= 2), lambda k: k.at), '{order}') as lines from i group by page_id"""


_LINES = f"i as materialized {in_sql(ITEMS)}, ys as materialized ({_fit('y', grid.Y_NEAR, 'DESC')}), xs as materialized ({_fit('x', grid.X_NEAR, 'ASC')})"
_SHOWN = "array_to_string(list_transform({}.lines, lambda v: v::int::varchar), ',')"
_X17A = f"with {_LINES} select ys.page_id, {_SHOWN.format('ys')} as ys, {_SHOWN.format('xs')} as xs from ys join xs using (page_id)"


def x17_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.cells(derived(spark, d, ITEMS))


_NUM = lambda c: f"length(regexp_replace(regexp_replace({c}, '[$,\\s]', '', 'g'), '[^0-9]', '', 'g')) > length(regexp_replace({c}, '[$,\\s]', '', 'g')) * 0.6"
_GRID = f"""{_LINES}, b as (select page_id, ys.lines as yl, xs.lines as xl from ys join xs using (page_id) where len(ys.lines) >= 2 and len(xs.lines) >= 2),
r as (select page_id, xl, unnest(yl) as cy, unnest(range(len(yl)))::int as row from b), g as (select page_id, row, cy, unnest(xl) as cx, unnest(range(len(xl)))::int as col from r),
h as (select r.page_id, row, count(*) filter (contains(lower(font), 'bold')) > count(*) / 2 as bold from r join i on i.page_id = r.page_id and abs(y - cy) <= 2 group by all),
cell as (select g.page_id, g.row, g.col, coalesce(string_agg(str, ' ' order by item_id), '') as content from g left join i on i.page_id = g.page_id and abs(y - cy) <= 2 and abs(x - cx) <= 3 group by all)"""
_X17B = f"with {_GRID} select c.page_id, c.row, col, content, case when {_NUM('content')} then 'right' else 'left' end as alignment, c.row = 0 or coalesce(bold, false) as header from cell c left join h using (page_id, row)"


def x17_lattice(spark: SparkSession, d: str) -> DataFrame:
    return grid.lattice(derived(spark, d, ITEMS))


def _regular(lines: str) -> str:
    gaps = f"list_transform(range(2, len({lines}) + 1), lambda i: abs({lines}[i] - {lines}[i - 1]))"
    return f"(len({lines}) >= 3 and list_avg(list_transform({gaps}, lambda g: abs(g - list_avg({gaps})))) < list_avg({gaps}) * 0.2)"


_LATTICE = f"""select b.page_id, len(yl)::int as rows, len(xl)::int as columns, round(least(1.0, 0.7 + case when {_regular("yl")} then 0.1 else 0 end + case when {_regular("xl")} then 0.1 else 0 end + 0.05), 4)::double as confidence
from b join (select page_id, avg(length(content)) as mean, avg(case when regexp_matches(content, '[.,]') then 1.0 else 0 end) as prose from cell group by page_id) using (page_id) where not (mean > 40 and prose > 0.5)"""


def x17_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The choice between the bordered table of each page and a borderless one that is found with a confidence by the page's number."""
    items = derived(spark, d, ITEMS)
    other = items.groupBy("page_id").agg(F.count("*").alias("n")).select("page_id", (0.4 + F.col("page_id") % 60 / 100).alias("confidence"))
    return grid.choose(grid.lattice(items), other, grid.page_shape(items))


_X17G = f"""with {_GRID}, a as ({_LATTICE}), s as (select *, x - lag(x + width) over (partition by page_id, floor(y / 10) order by x, item_id) as g from i),
p as (select page_id, round(coalesce(avg(g) filter (g > 0), 0), 6) as gap, round(coalesce(avg(case when {_NUM("str")} then 1.0 else 0 end) filter (trim(str) <> ''), 0), 6) as numeric from s group by page_id),
q as (select p.*, coalesce(a.confidence, 0) as a, 0.4::double + (page_id % 60) / 100.0::double as b from p left join a using (page_id)),
z as (select *, case when a >= 0.7 and b >= 0.7 then gap > 50 or numeric > 0.3 or b > a + 0.1::double else b >= 0.7 end as stream from q), u as (select *, case when stream then b else a end as sure from z)
select page_id, case when sure < 0.5 then 'none' when stream then 'stream' else 'lattice' end as method, (case when sure < 0.5 then 0 else sure end)::double as confidence, case when sure >= 0.7 then 'accepted' when sure >= 0.5 then 'low' else 'none' end as state from u"""


def a18_shapes(spark: SparkSession, d: str) -> DataFrame:
    return grid.page_shape(derived(spark, d, ITEMS))


_A18 = f"""with i as {in_sql(ITEMS)}, s as (select *, x - lag(x + width) over (partition by page_id, floor(y / 10) order by x, item_id) as g from i)
select page_id, round(coalesce(avg(g) filter (g > 0), 0), 6)::double as gap, round(coalesce(avg(case when {_NUM("str")} then 1.0 else 0 end) filter (trim(str) <> ''), 0), 6)::double as numeric from s group by page_id"""


def x17_merged(spark: SparkSession, d: str) -> DataFrame:
    header = F.when(F.col("kind") == 0, F.array(F.lit("A "), F.lit("b"))).otherwise(F.array(F.lit("Sum"), F.when(F.col("table_id") % 2 == 0, "x").otherwise("X")))
    rows = derived(spark, d, TABLES).withColumn("header", header).withColumn("rows", F.array(F.concat_ws(":", F.col("table_id").cast("string"), F.col("n").cast("string"))))
    out = grid.merge_tables(rows)
    return out.select("doc_id", "table_id", F.array_join("header", "|").alias("header"), F.array_join("rows", ",").alias("rows"), "x", "y", "x2", "y2", "confidence")


_X17H = f"""with k as (select *, case when kind = 0 then 'A |b' else 'Sum|' || case when table_id % 2 = 0 then 'x' else 'X' end end as header from {in_sql(TABLES)})
select doc_id, min(table_id) as table_id, arg_min(header, table_id) as header, string_agg(table_id || ':' || n, ',' order by table_id) as rows, min(x) as x, min(y) as y, max(x2) as x2, max(y2) as y2, round(avg(confidence), 6) as confidence from k group by doc_id, kind"""


def c17_documents(spark: SparkSession, d: str) -> DataFrame:
    """The types of all documents, whole."""
    rows = classify.classify(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "language", "doc_type", "confidence", "second", F.array_join("features", ",").alias("features"))


def c17_document_type(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(texts(spark, d)).select("doc_id", "language", "doc_type", "confidence", "second", F.array_join("features", ",").alias("features"))


def c18_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many texts each rule set applies to."""
    rows = classify.classify(texts(spark, d)).select(F.explode(classify.rules_of(F.col("doc_type"))).alias("rule"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"))


_C18 = f"with {T}, y as ({classify.classify_sql('t')}), r as (select unnest(case doc_type " + " ".join(f"when '{k}' then {list(x)!r}" for k, x in classify.RULE_SETS.items()) + " else []::varchar[] end) as rule from y) select rule, count(*) as n from r group by rule"
SPANS = """select o_orderkey as sample, '{"full_text":"Ann lives at ' || cast(o_custkey as string) || '","spans":[{"entity_type":"' || case o_orderkey % 4 when 0 then 'person' when 1 then 'LOCATION' when 2 then 'IBAN_CODE' else 'Title ' end || '","entity_value":"Ann","start_position":0,"end_position":3},
{"entity_type":"STREET","entity_value":"' || cast(o_custkey as string) || '","start_position":13,"end_position":' || cast(13 + length(cast(o_custkey as string)) as string) || '}]}' as line from orders"""


def s11_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Annotated samples, a JSON line each, as entities with this library's types."""
    from spanloom.sources.markup import annotated

    table(spark, d, "orders").createOrReplaceTempView("orders")
    return annotated(spark.sql(SPANS), "sample", "line").select("sample", "type", "start", "end", "text")


_S11 = """with s as (select o_orderkey as sample, o_orderkey % 4 as k, cast(o_custkey as varchar) as c from orders)
select sample, ['PERSON_NAME', 'ADDRESS', 'IBAN', 'TITLE'][k + 1] as type, 0 as start, 3 as "end", 'Ann' as text from s union all select sample, 'STREET', 13, (13 + length(c))::int, c from s"""


def k7_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each event type as a line of JSON: what an export of metrics holds."""
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("count"), F.min("user_id").alias("least"), F.max("user_id").alias("most"))
    return rows.select(F.to_json(F.struct("event_type", "count", "least", "most")).alias("line"))


def a18b_scale(spark: SparkSession, d: str) -> DataFrame:
    """The largest number of additions or dismissals of a type, which a chart is scaled by."""
    from spanloom.plans.inputs import corrections

    rows = corrections(spark, d).groupBy("entity_type").agg(F.count_if(F.col("action") == "ADD").alias("a"), F.count_if(F.col("action") == "DISMISS").alias("d"))
    return rows.agg(F.max(F.greatest("a", "d")).alias("most"))


def _scan_all(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(table(spark, d, "documents"), extract.HIGH_RECALL)


def p29_regex_risk(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", F.round(t.regex_risk(F.concat(F.lit("(a+)+|b*?|[c]+"), "text")), 4).alias("risk"))


_N = lambda p: f"len(regexp_extract_all(p, '{p}'))"
_P29 = f"""with {T}, k as (select doc_id, '(a+)+|b*?|[c]+' || text as p from t)
select doc_id, round(10 * {_N(r"\([^)]*[+*][^)]*\)[+*]")} + 5 * ({_N(r"[+*]")} - {_N(r"[+*]\?")}) + 3 * {_N(r"\[[^\]]+\][+*]")} + 2 * {_N(r"\|")} + length(p) / 50, 4)::double as risk from k"""
_CORR = """select event_id, case when event_id % 3 = 0 then 'ADD' else 'DISMISS' end as action, case event_id % 4 when 0 then 'EMAIL' when 1 then 'PERSON_NAME' when 2 then 'PHONE' else 'DATE' end as entity_type from events"""

_LENGTHS = "map {" + ", ".join(f"'{k}': {n}" for k, n in detector.LENGTHS.items()) + "}"
_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in detector.COMMON)
_CHECKED = f"""f as materialized {extract.extract_sql("t", extract.DETECTOR)},
ib0 as (select distinct text, upper(replace(regexp_replace(text, '\\s', '', 'g'), '-', '')) as code from f where starts_with(pattern, 'iban')),
ib1 as (select *, array_to_string(list_transform(string_split(substr(code, 5) || left(code, 4), ''), lambda ch: case when ascii(ch) >= 65 then (ascii(ch) - 55)::varchar else ch end), '') as num from ib0),
ib as (select text, coalesce(length(code) = {_LENGTHS}[left(code, 2)], false) and regexp_full_match(code, '[A-Z0-9]+') and coalesce(try_cast((try_cast(left(num, 30) as hugeint) % 97)::varchar || substr(num, 31) as hugeint) % 97 = 1, false) as ok from ib1),
w as (select f.*, ib.ok, regexp_replace(f.text, '[^0-9]', '', 'g') as d, regexp_split_to_array(trim(f.text), '\\s+') as parts, string_split(f.text, '.') as p from f left join ib on f.text = ib.text and starts_with(pattern, 'iban')),
k as (select doc_id, rank as entity_id, start, "end", type, text from w where case when starts_with(pattern, 'iban') then ok
  when pattern in ('avs', 'avs_nodots') then coalesce(length(d) = 13 and starts_with(d, '756') and try_cast(substr(d, 13, 1) as int) = (10 - ({detection._sum([1, 3] * 6)}) % 10) % 10, false)
  when pattern = 'date' then coalesce(len(p) = 3 and try_cast(p[1] as int) between 1 and 31 and try_cast(p[2] as int) between 1 and 12 and try_cast(p[3] as int) between 1900 and 2100, false)
  when pattern = 'street' then length(text) >= 5 and regexp_matches(text, '\\d+[A-Za-z]?\\s*$') and length(trim(regexp_replace(text, '\\s+\\d+[A-Za-z]?\\s*$', ''))) >= 5 and not regexp_matches(lower(text), 'case postale|postfach|p\\.o\\. box|boîte postale')
  when starts_with(pattern, 'person') then length(text) >= 3 and len(parts) >= 2 and len(list_filter(parts, lambda x: lower(x) in ({_COMMON}) or (x = upper(x) and length(x) > 2))) = 0 else true end),
l as (select doc_id, list({{'start': start, 'end': "end", 'type': type, 'text': text}} order by start, -({plans_entities._RANK.replace("{0}.", "")}), entity_id) as xs from k group by doc_id),
z as (select doc_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, y: case when y[1].start >= acc[-1]."end" then list_concat(acc, y) when {plans_entities._rank("y[1]")} > {plans_entities._rank("acc[-1]")} then list_concat(acc[:-2], y) else acc end)) as e from l)"""
_X3 = f"""with {T}, {_CHECKED} select doc_id, e.type as type, e.start as start, e."end" as "end", e.text as text from z"""


def x3_detect(spark: SparkSession, d: str) -> DataFrame:
    """The detector's finds in the texts, validated by pattern, and overlaps resolved by its order."""
    found = extract.extract(texts(spark, d), extract.DETECTOR)
    keep = F.lit(True)
    for name, check in detector.OF_PATTERN.items():
        keep = F.when(F.col("pattern") == name, check(F.col("text"))).otherwise(keep)
    rows = found.where(keep).select("doc_id", F.col("rank").alias("entity_id"), "start", "end", "type", "text", F.lit(0.7).alias("confidence"), F.lit("RULE").alias("source"))
    return overlap.priority_dedup(rows).select("doc_id", "type", "start", "end", "text")


#: What the texts are known to hold, by type: (type, column of the ids, remainder of the id by 4).
TRUTH = [("EMAIL", "email", (0, 1)), ("SWISS_AVS", "avs", (1,)), ("IBAN", "iban", (0, 2)), ("PHONE", "phone", (0, 2, 3)), ("DATE", "date", (0, 3))]


def a13_detector(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the detector, by type, against the identifiers that the texts were made of, right ones and wrong ones alike."""
    rows = None
    for kind, column, rest in TRUTH:
        one = ids(spark, d).where((F.col("doc_id") % 4).isin(*rest)).select("doc_id", F.lit(kind).alias("type"), F.col(column).alias("text"), F.lit(0).alias("start"))
        rows = one if rows is None else rows.unionByName(one)
    found = x3_detect(spark, d).where(F.col("type").isin(*[k for k, _, _ in TRUTH]))
    return analytics.precision_recall(found, rows, ["doc_id", "type", "text"])


_TRUE = " union all ".join(f"select doc_id, '{k}' as type, {c} as text from {IDS_SQL} where doc_id % 4 in {(*rest, 9)}" for k, c, rest in TRUTH)
_NTH = "row_number() over (partition by doc_id, type, text)"
_A13 = f"""with {T}, {_CHECKED}, a as (select doc_id, type, text, {_NTH} as n from (select doc_id, e.type as type, e.text as text from z) where type in ({", ".join(f"'{k}'" for k, _, _ in TRUTH)})), b as (select *, {_NTH} as n from ({_TRUE})),
c as (select coalesce(a.type, b.type) as type, count(*) filter (a.text is not null and b.text is not null) as tp, count(*) filter (b.text is null) as fp, count(*) filter (a.text is null) as fn from a full join b on a.doc_id = b.doc_id and a.type = b.type and a.text = b.text and a.n = b.n group by 1)
select *, {plans_analytics._RATES} from c"""

QUERIES = {
    "a13_detector": (a13_detector, _A13),
    "x3_detect": (x3_detect, _X3),
    "a18_shapes": (a18_shapes, _A18),
    "a18b_scale": (a18b_scale, f"select max(greatest(a, d)) as most from (select entity_type, count(*) filter (action = 'ADD') as a, count(*) filter (action = 'DISMISS') as d from ({_CORR}) group by entity_type)"),
    "c8_runtime": (c8_runtime, _C8),
    "c9_enhanced": (c9_enhanced, _C9),
    "c17_document_type": (c17_document_type, f"with {T} {classify.classify_sql('t').replace('with d as', ', d as', 1)}"),
    "c17_documents": (c17_documents, classify.classify_sql("documents")),
    "c18_rules": (c18_rules, _C18),
    "j6_columns": (j6_columns, f"with {E}, c as (select *, ['Mail', 'NAME', 'x'][entity_id % 3 + 1] as col from e) select doc_id, entity_id, round(least(1.0, confidence + case when col = 'Mail' and type = 'EMAIL' then 0.5 when col = 'NAME' and type = 'PERSON_NAME' then 0.2 else 0 end), 6)::double as boosted from c"),
    "j8_cities": (j8_cities, _J8),
    "k7_metrics": (k7_metrics, """select '{"event_type":"' || event_type || '","count":' || count(*) || ',"least":' || min(user_id) || ',"most":' || max(user_id) || '}' as line from events group by event_type"""),
    "o6_proximity": (o6_proximity, _O6),
    "o10_types": (o10_types, _O10),
    "o13c_preview": (o13c_preview, _O13C),
    "o16_offsets": (o16_offsets, _O16),
    "p7_title_key": (p7_title_key, _P7),
    "p13_joined": (p13_joined, _p13_sql()),
    "p16_layouts": (p16_layouts, _P16),
    "p16b_raw": (p16b_raw, _P16B),
    "p19_escaped": (p19_escaped, f"with {T} select doc_id, regexp_replace(text || '[a](b)\\ {{c}}^$|?*+', '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g') as pattern from t"),
    "p29_regex_risk": (p29_regex_risk, _P29),
    "s11_fixtures": (s11_fixtures, _S11),
    "t6_guarded": (t6_guarded, "select doc_id, length(text) <= 2000 as success, case when length(text) <= 2000 then regexp_matches(text, '\\b\\d{3}\\b') end as value, case when length(text) > 2000 then 'Input exceeds maximum length (' || length(text) || ' > 2000)' end as error from documents"),
    "v12_registry": (v12_registry, _V12),
    "v16_groups": (v16_groups, _V16),
    "x1_documents": (_scan_all, f"select * from {extract.extract_sql('documents', extract.HIGH_RECALL)}"),
    "x10_registry": (x10_registry, _X10),
    "x13_token_chunks": (x13_token_chunks, None),
    "x17_cells": (x17_cells, _X17B),
    "x17_chosen": (x17_chosen, _X17G),
    "x17_lattice": (x17_lattice, f"with {_GRID} {_LATTICE}"),
    "x17_lines": (x17_lines, _X17A),
    "x17_merged": (x17_merged, _X17H),
}
