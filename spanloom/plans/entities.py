"""Queries on entities: overlaps, groups, scores, links, pseudonyms and rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import validators as v
from spanloom.functions.spans import spans_sql
from spanloom.operators import extract, linking, overlap, scoring
from spanloom.plans.inputs import ENTITIES_SQL, TEXTS_SQL, entities, table, texts

E = f"e as {ENTITIES_SQL}"
_STRUCT = "{'entity_id': entity_id, 'start': start, 'end': \"end\", 'type': type, 'text': text, 'confidence': confidence, 'source': source, 'seed': \"end\"}"
_RANK = "coalesce(map {" + ", ".join(f"'{k}': {n}" for k, n in overlap.TYPE_RANK.items()) + "}[{0}.type], 0)"


def _rank(x: str) -> str:
    return _RANK.replace("{0}", x)


def _with(x: str, **changed: str) -> str:
    return "{" + ", ".join(f"'{f}': {changed.get(f, f'{x}.{f}' if f != 'end' else x + '.' + chr(34) + 'end' + chr(34))}" for f in (*overlap.FIELDS, "seed")) + "}"


def _fold(order: str, arms: list[tuple[str, str]]) -> str:
    step = " ".join(f"when {c} then {r}" for c, r in arms)
    return f"""with {E}, l as (select doc_id, list({_STRUCT} order by {order}, entity_id) as xs from e group by doc_id),
f as (select doc_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, y: case {step} else acc end)) as k from l)
select doc_id, k.entity_id, k.start, k."end" as "end", k.type, k.text, k.confidence, k.source from f"""


_APART = ('y[1].start >= acc[-1]."end"', "list_concat(acc, y)")
_REPLACE = "list_concat(acc[:-2], y)"
_BOTH = _with("acc[-1]", end='greatest(acc[-1]."end", y[1]."end")', confidence="greatest(acc[-1].confidence, y[1].confidence)", source="'BOTH'")
_worth = lambda x: f"{_rank(x)} * {x}.confidence"
_SEEDED = f"[{_with('y[1]', seed='acc[-1].seed')}]"


def fold(run):
    return lambda spark, d: run(entities(spark, d))


def o6_gap_groups(spark: SparkSession, d: str) -> DataFrame:
    return overlap.gap_groups(entities(spark, d), 10).select("doc_id", "entity_id", F.col("group").alias("grp"))


_GAP = """g0 as (select *, max("end") over (partition by doc_id order by start, "end", entity_id rows between unbounded preceding and 1 preceding) as reach from e),
g as (select *, sum(case when start - reach <= 10 then 0 else 1 end) over (partition by doc_id order by start, "end", entity_id rows unbounded preceding)::int as grp from g0)"""


def o11_grouped(spark: SparkSession, d: str) -> DataFrame:
    return overlap.grouped(entities(spark, d), 10).withColumnRenamed("group", "grp")


def c_factors(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.related_factor(entities(spark, d)).withColumn("position", scoring.position_factor(F.col("start"), F.col("type"), F.lit(200)))
    rows = rows.withColumn("repetition", scoring.repetition_factor())
    score = scoring.combined(F.col("confidence"), related=F.col("related"), position=F.col("position"), repetition=F.col("repetition"))
    return rows.select("doc_id", "entity_id", "related", "position", "repetition", score.alias("score"))


_RELATED = " or ".join(f"(a.type = '{k}' and b.type in ({', '.join(repr(t) for t in types)}))" for k, types in scoring.RELATED.items())
_FACTORS = f"""with {E}, r as (select a.doc_id, a.entity_id, exists (select 1 from e b where b.doc_id = a.doc_id and b.entity_id <> a.entity_id and greatest(b.start - a."end", a.start - b."end", 0) <= 50 and ({_RELATED})) as related,
  not (a.type = 'IBAN' and (a.start < 20.0 or a.start > 180.0)) as position, count(*) over (partition by doc_id, type, text) > 1 as repetition, confidence from e a)
select doc_id, entity_id, related, position, repetition, round(least(1.0, confidence * (0.7 + 0.6 * ((case when related then 0.3 else 0 end + case when position then 0.15 else 0 end + case when repetition then 0.2 else 0 end)::double / 0.9::double))), 6) as score from r"""


def c2_label_factor(spark: SparkSession, d: str) -> DataFrame:
    """High-recall entities of the texts, and whether a word of their type stands before them."""
    found = extract.extract(texts(spark, d).withColumn("full", F.col("text")), extract.HIGH_RECALL, keep=("full",))
    return scoring.label_factor(found).select("doc_id", "pattern", "start", "labelled")


_BEFORE = "lower(substr(full_text, greatest(1, start - 50 + 1), least(50, start)))"
_LABELS = " ".join(f"when type = '{k}' then {' or '.join(f'contains({_BEFORE}, {chr(39)}{w}{chr(39)})' for w in words)}" for k, words in scoring.LABELS.items())


def c12_zones(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).withColumns({"length": F.lit(200), "doc_type": F.when(F.col("doc_id") % 2 == 0, "LETTER").otherwise("INVOICE")})
    return scoring.adjusted_by_zone(rows).select("doc_id", "entity_id", "zone", "adjusted")


_ZONE = "case when start < 40 then 'header' when start > 160 then 'footer' else 'body' end"
_DELTAS = " ".join(f"when doc_type = '{a}' and type = '{b}' and zone = '{c}' then {x}" for (a, b, c), x in scoring.ZONE_DELTAS.items())


def c11_thresholds(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return entities(spark, d).select("doc_id", "entity_id", scoring.classified(c).alias("class"), (c < scoring.REVIEW_BELOW).alias("flagged"), (c >= scoring.REVIEW_BELOW).alias("selected"))


def c7_regions(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("region"), lo.cast("int").alias("lo"), (lo + w).cast("int").alias("hi")) for n, lo, w in (("a", F.col("o_custkey") % 50, 70), ("b", F.col("o_custkey") % 90, 90))])).alias("r"))
    return scoring.boosted_by_region(entities(spark, d), regions.select("doc_id", "r.*")).select("doc_id", "entity_id", "region", "boosted")


def j2_deny_list(spark: SparkSession, d: str) -> DataFrame:
    """Entities that no deny rule drops: exact texts in lower case, or patterns of their type."""
    denied = spark.createDataFrame([("anna  muster",), ("name 3",)], "denied string")
    kept = entities(spark, d).join(F.broadcast(denied), F.lower("text") == F.col("denied"), "left_anti")
    return kept.where(~((F.col("type") == "PERSON_NAME") & F.col("text").rlike("^[A-Z]+ muster$"))).select("doc_id", "entity_id", "type", "text")


def j9_overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d)
    return overlap.without_overlaps(rows.where("type <> 'ADDRESS'"), rows.where("type = 'ADDRESS'")).select("doc_id", "entity_id", "start", "end")


def j15_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping(entities(spark, d))


def j12_golden(spark: SparkSession, d: str) -> DataFrame:
    """ML entities against those of rules by (text, type) and occurrence: matched, missing or extra, and whether confidences agree."""
    rows = entities(spark, d).withColumn("n", F.expr("row_number() over (partition by doc_id, source, type, text order by start, entity_id)"))
    side = lambda s, p: rows.where(F.col("source") == s).select("doc_id", "type", "text", "n", F.col("confidence").alias(p))
    both = side("ML", "a").join(side("RULE", "b"), ["doc_id", "type", "text", "n"], "full_outer")
    state = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("matched")
    return both.select("doc_id", "type", "text", "n", state.alias("state"), (F.abs(F.col("a") - F.col("b")) <= 0.05).alias("agree"))


def o12_links(spark: SparkSession, d: str) -> DataFrame:
    return linking.link(entities(spark, d)).select("doc_id", "entity_id", "logical_id")


def o13_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    return linking.pseudonyms(entities(spark, d)).select("doc_id", "entity_id", "pseudonym")


def o13d_linked_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    return linking.pseudonyms(linking.link(entities(spark, d)), "logical_id").select("doc_id", "entity_id", "pseudonym")


_KEY = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_LINK = f"""k as (select *, {_KEY} as key from e), n as (select *, count(*) over (partition by doc_id, type, key) as n, min((start, entity_id)) over (partition by doc_id, type, key) as first from k),
lk as (select *, case when n > 1 then type || '_' || dense_rank() over (partition by doc_id, type, n > 1 order by first) end as logical_id from n)"""
_PSEUDO = "select doc_id, entity_id, type || '_' || dense_rank() over (partition by doc_id, type order by f) as pseudonym from (select *, min((start, entity_id)) over (partition by doc_id, type, {key}) as f from {src})"


def flagship_pseudonymise(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their e-mail addresses replaced: found, validated, numbered by first appearance, spliced."""
    docs = table(spark, d, "documents")
    found = extract.extract(docs, extract.HIGH_RECALL[2:3]).where(v.email(F.col("text"))["valid"]).withColumn("entity_id", F.col("start"))
    edits = linking.pseudonyms(found).select("doc_id", "start", "end", F.col("pseudonym").alias("token"))
    return linking.rewrite(docs, edits).select("doc_id", "rewritten", "n_entities")


_MAIL = spans_sql("documents", "doc_id", "text", extract.HIGH_RECALL[2].regex)


def splice_sql(docs: str, edits: str) -> str:
    """SQL for (doc_id, rewritten, n_entities) of docs (doc_id, text) and edits (doc_id, start, end, token): the pieces before each edit, and the rest."""
    return f"""select doc_id, coalesce(pieces || substr(text, last + 1), text) as rewritten, coalesce(n, 0)::bigint as n_entities from {docs} left join (
  select doc_id, string_agg(substr(text, prev + 1, start - prev) || token, '' order by start) as pieces, max("end") as last, count(*) as n from (
    select s.*, d.text, coalesce(lag("end") over (partition by s.doc_id order by start), 0) as prev from {edits} s join {docs} d using (doc_id)) group by doc_id) using (doc_id)"""


_RFC = v.EMAIL.replace("'", "''")
_FLAG = f"""with f as (select * from {_MAIL} where length(text) <= 254 and regexp_matches(lower(text), '{_RFC}') and not contains(text, '..') and length(split_part(text, '.', -1)) >= 2),
r as (select *, min(start) over (partition by doc_id, text) as first from f), p as (select doc_id, start, "end", 'EMAIL_' || dense_rank() over (partition by doc_id order by first) as token from r)
{splice_sql("documents", "p")}"""


def o14_splice(spark: SparkSession, d: str) -> DataFrame:
    """All high-recall entities of the texts, resolved and replaced."""
    t = texts(spark, d)
    found = extract.extract(t, extract.HIGH_RECALL).select("doc_id", F.col("rank").alias("entity_id"), "start", "end", "type", "text", F.lit(0.7).alias("confidence"), F.lit("RULE").alias("source"))
    found = overlap.final_dedup(found)
    edits = linking.pseudonyms(found).select("doc_id", "start", "end", F.col("pseudonym").alias("token"))
    return linking.rewrite(t, edits).select("doc_id", "rewritten", "n_entities")


_O14 = f"""with t as materialized {TEXTS_SQL}, f as materialized (select *, rank as entity_id from {extract.extract_sql("t", extract.HIGH_RECALL)}),
l as (select doc_id, list({{'start': start, 'end': "end", 'type': type, 'text': text, 'entity_id': entity_id}} order by start, "end" desc, entity_id) as xs from f group by doc_id),
k as (select doc_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, y: case when y[1].start >= acc[-1]."end" then list_concat(acc, y) else acc end)) as x from l),
s as (select doc_id, x.start as start, x."end" as "end", x.type as type, x.text as text, x.entity_id as entity_id from k),
r as (select *, min((start, entity_id)) over (partition by doc_id, type, text) as first from s),
p as (select doc_id, start, "end", type || '_' || dense_rank() over (partition by doc_id, type order by first) as token from r)
{splice_sql("t", "p")}"""


def k2_mapping(spark: SparkSession, d: str) -> DataFrame:
    return linking.mapping_json(linking.pseudonyms(entities(spark, d)))


_AT = 'list_position(list_transform(acc, lambda k: k.start < y[1]."end" and y[1].start < k."end"), true)'
QUERIES = {
    "flagship_pseudonymise": (flagship_pseudonymise, _FLAG),
    "o1_source_merge": (fold(overlap.merge_sources), _fold("start", [_APART, ("y[1].source <> acc[-1].source and acc[-1].source <> 'BOTH'", f"list_concat(acc[:-2], [{_BOTH}])")])),
    "o2_final_dedup": (fold(overlap.final_dedup), _fold('start, start - "end"', [_APART, ("y[1].confidence > acc[-1].confidence", _REPLACE)])),
    "o3_priority_dedup": (fold(overlap.priority_dedup), _fold(f"start, -({_RANK.replace('{0}.', '')})", [_APART, (f"{_rank('y[1]')} > {_rank('acc[-1]')}", _REPLACE)])),
    "o4_rule_dedup": (fold(overlap.rule_dedup), _fold("entity_id", [("len(list_filter(acc, lambda k: k.start < y[1].\"end\" and y[1].start < k.\"end\")) = 0", "list_concat(acc, y)"), (f"y[1].confidence > acc[{_AT}].confidence", f"list_concat(list_concat(acc[1:{_AT} - 1], y), acc[{_AT} + 1:len(acc)])")])),
    "o5_consolidate": (fold(overlap.consolidate), _fold("start", [("y[1].start >= acc[-1].seed", "list_concat(acc, y)"), (f"{_worth('y[1]')} > {_worth('acc[-1]')} or ({_worth('y[1]')} = {_worth('acc[-1]')} and y[1].\"end\" - y[1].start > acc[-1].\"end\" - acc[-1].start)", f"list_concat(acc[:-2], {_SEEDED})")])),
    "o6_gap_groups": (o6_gap_groups, f"with {E}, {_GAP} select doc_id, entity_id, grp from g"),
    "o11_grouped": (o11_grouped, f"""with {E}, {_GAP} select doc_id, grp, min(start) as start, max("end") as "end", count(*) as n, round(avg(confidence), 6) as confidence, string_agg(type, ',' order by start, "end", entity_id) as types from g group by doc_id, grp having count(*) >= 2 and round(avg(confidence), 6) >= 0.5"""),
    "c2_label_factor": (c2_label_factor, f"with t as materialized {TEXTS_SQL}, f as (select f.*, t.text as full_text from {extract.extract_sql('t', extract.HIGH_RECALL)} f join t using (doc_id)) select doc_id, pattern, start, case {_LABELS} else false end as labelled from f"),
    "c3_c6_factors": (c_factors, _FACTORS),
    "c7_regions": (c7_regions, f"""with {E}, r as (select o_orderkey as doc_id, 'a' as region, o_custkey % 50 as lo, o_custkey % 50 + 70 as hi from orders union all select o_orderkey, 'b', o_custkey % 90, o_custkey % 90 + 90 from orders),
h as (select e.doc_id, entity_id, min(region) as region from e join r on e.doc_id = r.doc_id and start >= lo and "end" <= hi group by all)
select e.doc_id, e.entity_id, region, round(case when region is not null then least(1.0, confidence + 0.2) else confidence end, 6) as boosted from e left join h on e.doc_id = h.doc_id and e.entity_id = h.entity_id"""),
    "c11_thresholds": (c11_thresholds, f"with {E} select doc_id, entity_id, case when confidence < 0.3 then 'drop' when confidence < 0.6 then 'review' when confidence >= 0.85 then 'auto' else 'keep' end as class, confidence < 0.6 as flagged, confidence >= 0.6 as selected from e"),
    "c12_zones": (c12_zones, f"with {E}, z as (select *, {_ZONE} as zone, case when doc_id % 2 = 0 then 'LETTER' else 'INVOICE' end as doc_type from e) select doc_id, entity_id, zone, round(least(1.0, confidence + case {_DELTAS} else 0 end), 6)::double as adjusted from z"),
    "j2_deny_list": (j2_deny_list, f"with {E} select doc_id, entity_id, type, text from e where lower(text) not in ('anna  muster', 'name 3') and not (type = 'PERSON_NAME' and regexp_matches(text, '^[A-Z]+ muster$'))"),
    "j9_overlap_anti": (j9_overlap_anti, f"""with {E} select doc_id, entity_id, start, "end" from e a where type <> 'ADDRESS' and not exists (select 1 from e b where b.type = 'ADDRESS' and a.doc_id = b.doc_id and a.start < b."end" and b.start < a."end")"""),
    "j12_golden": (j12_golden, f"""with {E}, r as (select *, row_number() over (partition by doc_id, source, type, text order by start, entity_id)::int as n from e), a as (select * from r where source = 'ML'), b as (select * from r where source = 'RULE')
select doc_id, type, text, n, case when a.confidence is null then 'extra' when b.confidence is null then 'missing' else 'matched' end as state, abs(a.confidence - b.confidence) <= 0.05 as agree from a full join b using (doc_id, type, text, n)"""),
    "j15_overlapping": (j15_overlapping, f"""with {E} select a.doc_id, a.entity_id, count(b.entity_id) as n, min(b.entity_id) as least from e a left join e b on a.doc_id = b.doc_id and a.entity_id <> b.entity_id and a.start < b."end" and b.start < a."end" group by all"""),
    "o12_links": (o12_links, f"with {E}, {_LINK} select doc_id, entity_id, logical_id from lk"),
    "o13_pseudonyms": (o13_pseudonyms, f"with {E} {_PSEUDO.format(key='text', src='e')}"),
    "o13d_linked_pseudonyms": (o13d_linked_pseudonyms, f"with {E}, {_LINK} {_PSEUDO.format(key='coalesce(logical_id, text)', src='lk')}"),
    "o14_splice": (o14_splice, _O14),
    "k2_mapping": (k2_mapping, f"""with {E}, p as ({_PSEUDO.format(key='text', src='e')}), q as (select distinct e.doc_id, text, pseudonym from e join p on e.doc_id = p.doc_id and e.entity_id = p.entity_id)
select doc_id, '[' || string_agg('{{"original":"' || text || '","replacement":"' || pseudonym || '"}}', ',' order by text, pseudonym) || ']' as mapping from q group by doc_id"""),
}
