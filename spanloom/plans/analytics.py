"""Queries of analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import analytics as a
from spanloom.plans.inputs import CORRECTIONS_SQL, ENTITIES_SQL, corrections, entities, table

C, E = f"c as {CORRECTIONS_SQL}", f"e as {ENTITIES_SQL}"
_TREND = "count(*) filter (action = 'DISMISS') as dismissals, count(*) filter (action = 'ADD') as additions, count(*) as total"


def _log(run):
    return lambda spark, d: run(corrections(spark, d))


def _entities(run):
    return lambda spark, d: run(entities(spark, d))


def a2_by_type_and_source(rows: DataFrame) -> DataFrame:
    sets = rows.groupingSets([[F.col("type"), F.col("source")], [F.col("type")], []], F.col("type"), F.col("source"))
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean"))


def a12_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("duration"), F.expr("case when o_orderkey % 6 = 0 then null else o_orderpriority end").alias("kind"), F.col("o_orderstatus").alias("lang"))
    return a.latency_metrics(rows)


def a13_precision_recall(rows: DataFrame) -> DataFrame:
    return a.precision_recall(rows.where("source = 'ML'"), rows.where("source = 'RULE'"), ["doc_id", "type", "text"])


def a14_micro_average(rows: DataFrame) -> DataFrame:
    by_type = a13_precision_recall(rows)
    return a.with_rates(by_type.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


_PR = f"""{E}, r as (select *, row_number() over (partition by source, doc_id, type, text order by start) as n from e), x as (select * from r where source = 'ML'), y as (select * from r where source = 'RULE'),
p as (select type, count(*) filter (x.start is not null and y.start is not null) as tp, count(*) filter (y.start is null) as fp, count(*) filter (x.start is null) as fn from x full join y using (doc_id, type, text, n) group by type)"""
_RATES = "coalesce(round(tp / nullif(tp + fp, 0), 6), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) as recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) as f1"


def a9_confusion(log: DataFrame) -> DataFrame:
    """Dismissals and additions by type as columns."""
    return log.groupBy("entity_type").pivot("action", ["ADD", "DISMISS"]).agg(F.count("id")).select("entity_type", F.coalesce("ADD", F.lit(0)).alias("missed"), F.coalesce("DISMISS", F.lit(0)).alias("false_positives"))


def a10_converted(log: DataFrame) -> DataFrame:
    name = F.create_map(F.lit("DISMISS"), F.lit("mark_as_not_pii"), F.lit("ADD"), F.lit("mark_as_pii"))[F.col("action")]
    return log.select("id", name.alias("event"), F.substring(F.sha2(F.col("document").cast("string"), 256), 1, 16).alias("document_hash"))


def a16_review(rows: DataFrame) -> DataFrame:
    """By type, how many entities are to be reviewed, kept or dropped."""
    c = F.col("confidence")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if(c < 0.3).alias("dropped"), F.count_if((c >= 0.3) & (c < 0.6)).alias("flagged"), F.count_if(c >= 0.6).alias("kept"))


def w4_top(rows: DataFrame) -> DataFrame:
    """The ten surest entities of each type."""
    return rows.withColumn("n", F.expr("row_number() over (partition by type order by confidence desc, doc_id, entity_id)")).where("n <= 10").select("type", "n", "doc_id", "entity_id")


def w8_recent(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(25).select("id", "action")


def w10_index(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "entity_id", F.expr("row_number() over (partition by doc_id order by start, entity_id)").alias("position"))


def w11_ring(log: DataFrame) -> DataFrame:
    """Each type's newest hundred rows."""
    return log.withColumn("n", F.expr("row_number() over (partition by entity_type order by ts desc, id desc)")).where("n <= 100").select("id", "entity_type", "n")


def t7_latest_action(log: DataFrame) -> DataFrame:
    """The latest action on each (document, text): later actions win."""
    return log.groupBy("document", "text").agg(F.max_by("action", F.struct("ts", "id")).alias("action"), F.count("*").alias("n"))


def k5_csv(log: DataFrame) -> DataFrame:
    text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("="), "text")).when(F.col("id") % 4 == 1, F.concat("text", F.lit(',"x"'))).otherwise(F.col("text"))
    return log.select("id", F.concat_ws(",", F.col("id").cast("string"), a.csv_cell(text), "action").alias("line"))


def k6_export(log: DataFrame) -> DataFrame:
    """Log rows as JSON lines, texts replaced by the head of their digest."""
    return log.select("id", F.to_json(F.struct(F.col("id"), F.col("action"), F.col("entity_type"), F.substring(F.sha2("text", 256), 1, 12).alias("text"))).alias("line"))


_K5 = "case id % 4 when 0 then '\"''=' || text || '\"' when 1 then '\"' || text || ',\"\"x\"\"\"' else text end"

QUERIES = {
    "a1_by_type": (_entities(lambda r: r.groupBy("type").agg(F.count("*").alias("n"))), f"with {E} select type, count(*) as n from e group by type"),
    "a2_by_type_and_source": (_entities(a2_by_type_and_source), f"with {E} select type, source, count(*) as n, round(avg(confidence), 6) as mean from e group by grouping sets ((type, source), (type), ())"),
    "a3_summary": (_log(a.correction_summary), f"with {C} select count(*) as total, count(*) filter (action = 'DISMISS') as dismissals, count(*) filter (action = 'ADD') as additions, count(distinct document) as documents, round(count(*) filter (action = 'DISMISS') / count(*), 6) as dismissal_rate, round(count(*) filter (action = 'ADD') / count(*), 6) as addition_rate from c"),
    "a4_by_type": (_log(a.by_type), f"with {C} select entity_type, {_TREND} from c group by entity_type"),
    "a5_weekly": (_log(lambda r: a.trend(r, a.week_of(F.col("ts")))), f"with {C} select year(ts) || '-W' || lpad(weekofyear(ts)::varchar, 2, '0') as period, {_TREND} from c group by 1"),
    "a6_monthly": (_log(lambda r: a.trend(r, a.month_of(F.col("ts")))), f"with {C} select strftime(ts, '%Y-%m') as period, {_TREND} from c group by 1"),
    "a7_period": (_log(lambda r: a.period_bounds(r).select(F.date_format("first", "yyyy-MM-dd HH:mm").alias("first"), F.date_format("last", "yyyy-MM-dd HH:mm").alias("last"))), f"with {C} select strftime(min(ts), '%Y-%m-%d %H:%M') as first, strftime(max(ts), '%Y-%m-%d %H:%M') as last from c"),
    "a8_patterns": (_log(lambda r: a.frequent_patterns(r).select("pattern", "entity_type", "n", "sources", F.round("confidence", 4).alias("confidence"))), f"with {C} select lower(text) as pattern, entity_type, count(*) as n, coalesce(string_agg(distinct source, ',' order by source), '') as sources, round(round(case when sum(confidence) > 0 then sum(confidence) / count(*) end, 6), 4) as confidence from c group by 1, 2 having count(*) >= 2 order by n desc, pattern, entity_type limit 20"),
    "a9_confusion": (_log(a9_confusion), f"with {C} select entity_type, count(*) filter (action = 'ADD') as missed, count(*) filter (action = 'DISMISS') as false_positives from c group by 1"),
    "a10_converted": (_log(a10_converted), f"with {C} select id, case action when 'DISMISS' then 'mark_as_not_pii' else 'mark_as_pii' end as event, left(sha256(document::varchar), 16) as document_hash from c"),
    "a12_latency": (a12_latency, "with r as (select o_totalprice::double as duration, coalesce(case when o_orderkey % 6 = 0 then null else o_orderpriority end, 'unknown') as kind, coalesce(o_orderstatus, 'unknown') as lang from orders) select kind, lang, count(*) as n, round(avg(duration), 6) as mean, min(duration) as least, max(duration) as most, quantile_disc(duration, 0.5) as p50, quantile_disc(duration, 0.95) as p95, quantile_disc(duration, 0.99) as p99 from r group by grouping sets ((), (kind), (lang))"),
    "a13_precision_recall": (_entities(a13_precision_recall), f"with {_PR} select *, {_RATES} from p"),
    "a14_micro_average": (_entities(a14_micro_average), f"with {_PR}, s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from p) select *, {_RATES} from s"),
    "a16_review": (_entities(a16_review), f"with {E} select type, count(*) as n, count(*) filter (confidence < 0.3) as dropped, count(*) filter (confidence >= 0.3 and confidence < 0.6) as flagged, count(*) filter (confidence >= 0.6) as kept from e group by type"),
    "s8_capped_scan": (_log(lambda r: a.capped_scan(r, 2, 50).select("id", "month")), f"with {C}, m as (select *, strftime(ts, '%Y-%m') as month from c), f as (select distinct month from m order by month desc limit 2), n as (select *, row_number() over (partition by month order by ts, id) as n from m where month in (select month from f)) select id, month from n where n <= 50"),
    "t2_retention": (_log(lambda r: a.retained(r, F.lit("2024-02-01").cast("timestamp"), 30, 200).select("id", "action")), f"with {C}, y as (select *, row_number() over (partition by strftime(ts, '%Y-%m') order by ts desc, id desc) as n from c where ts >= timestamp '2024-02-01' - interval 30 day) select id, action from y where n <= 200"),
    "t7_latest_action": (_log(t7_latest_action), f"with {C} select document, text, max_by(action, (ts, id)) as action, count(*) as n from c group by 1, 2"),
    "v20_date_range": (_log(lambda r: a.in_range(r, "2024-01-05", "not a date").groupBy("action").agg(F.count("*").alias("n"))), f"with {C} select action, count(*) as n from c where ts >= timestamp '2024-01-05' group by 1"),
    "w4_top": (_entities(w4_top), f"with {E}, r as (select *, row_number() over (partition by type order by confidence desc, doc_id, entity_id)::int as n from e) select type, n, doc_id, entity_id from r where n <= 10"),
    "w8_recent": (_log(w8_recent), f"with {C} select id, action from c order by ts desc, id desc limit 25"),
    "w10_index": (_entities(w10_index), f"with {E} select doc_id, entity_id, row_number() over (partition by doc_id order by start, entity_id)::int as position from e"),
    "w11_ring": (_log(w11_ring), f"with {C}, r as (select *, row_number() over (partition by entity_type order by ts desc, id desc)::int as n from c) select id, entity_type, n from r where n <= 100"),
    "k5_csv": (_log(k5_csv), f"with {C} select id, id || ',' || {_K5} || ',' || action as line from c"),
    "k6_export": (_log(k6_export), f"""with {C} select id, '{{"id":' || id || ',"action":"' || action || '","entity_type":"' || entity_type || '","text":"' || left(sha256(text), 12) || '"}}' as line from c"""),
}
