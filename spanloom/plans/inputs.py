"""Inputs of the queries: tables, and texts, entities and logs that SQL derives from the tables' keys, alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """The rows of a query over the tables, or over those that are given in their place."""
    used = {t: given[t] if t in given else table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def in_sql(sql: str) -> str:
    """The same query for the comparison engine, as a subquery."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return f"({sql})"


def _pad(expression: str, n: int) -> str:
    return f"lpad(cast({expression} as string), {n}, '0')"


K = "c_custkey"
IDS = f"""select {K} as doc_id,
  '756.' || {_pad(f"{K} * 37 % 10000", 4)} || '.' || {_pad(f"{K} * 91 % 10000", 4)} || '.' || {_pad(f"{K} * 13 % 100", 2)} as avs,
  'CH' || {_pad(f"{K} % 100", 2)} || ' 0076 2011 ' || {_pad(f"{K} * 7919 % 10000", 4)} || ' ' || {_pad(f"{K} * 31 % 10000", 4)} || ' ' || {_pad(f"{K} % 10", 1)} as iban,
  'CHE-' || {_pad(f"{K} * 17 % 1000", 3)} || '.' || {_pad(f"{K} * 71 % 1000", 3)} || '.' || {_pad(f"{K} * 3 % 1000", 3)} as vat,
  case {K} % 4 when 0 then '+41 79 ' when 1 then '+41 44 ' when 2 then '+99 12 ' else '078 ' end || {_pad(f"{K} % 1000", 3)} || ' ' || {_pad(f"{K} * 7 % 100", 2)} || ' ' || {_pad(f"{K} * 11 % 100", 2)} as phone,
  case {K} % 5 when 0 then 'a..b' when 1 then 'x' else 'anna.m' || cast({K} as string) end || '@mail' || cast({K} % 7 as string) || case {K} % 3 when 0 then '.example.com' when 1 then '.ch' else '.e' end as email,
  case {K} % 3 when 0 then {_pad(f"{K} % 33", 2)} || '.' || {_pad(f"{K} % 14", 2)} || '.' || cast(1880 + {K} % 250 as string) when 1 then cast({K} % 31 + 1 as string) || '. März ' || cast(1990 + {K} % 30 as string) else {_pad(f"{K} % 30", 2)} || '/' || {_pad(f"{K} % 13", 2)} || '/' || {_pad(f"{K} % 100", 2)} end as date,
  cast(900 + {K} * 13 % 9400 as string) || case {K} % 5 when 0 then ' Sion' when 1 then ' Zürich' when 2 then ' Attestation' when 3 then ' Mai' else ' Lausanne' end as address
from {{customer}}"""

NL = "chr(10)"
TEXTS = f"""select doc_id, case doc_id % 4
  when 0 then 'Rechnung Nr. RE-' || cast(doc_id as string) || {NL} || 'Datum: ' || date || {NL} || 'Anna Muster' || {NL} || 'Bahnhofstrasse ' || cast(doc_id % 90 + 1 as string) || {NL} || '8001 Zürich' || {NL} || 'Tel. ' || phone || {NL} || 'E-Mail: ' || email || {NL} || 'IBAN: ' || iban || {NL} || 'Betrag: CHF 1''250.50 total mwst ' || vat || ' MWST'
  when 1 then 'Madame, Monsieur' || {NL} || 'Rue de la Gare ' || cast(doc_id % 50 + 1 as string) || {NL} || address || {NL} || 'Contact Jean Dupont' || {NL} || 'numéro avs ' || avs || ' et ' || email || {NL} || 'le ' || cast(doc_id % 28 + 1 as string) || ' janvier 2023. Cordialement, Credit Suisse Group AG' || {NL} || 'Marie Curie'
  when 2 then '# Agreement' || {NL} || 'between the parties whereas Roche Holding AG and UBS AG hereby agree, clause ' || cast(doc_id as string) || {NL} || 'Phone: ' || phone || ', ' || phone || {NL} || 'IBAN ' || replace(iban, ' ', '') || ' ' || iban || {NL} || 'D-10115 Berlin, 75001 Paris, DE123456789' || {NL} || 'ref 12 34567 89012 34567 89012 345678'
  else 'Gentile cliente' || {NL} || 'Via Nassa ' || cast(doc_id % 40 + 1 as string) || {NL} || '6900 Lugano' || {NL} || 'Partita ' || vat || ' IVA, conto 01-' || lpad(cast(doc_id as string), 6, '0') || '-3, targa TI ' || cast(doc_id * 7 as string) || {NL} || 'X1234567 Sandro Meyer, Tél. ' || phone || {NL} || 'john (at) example (dot) com, ***@mail.ch' || {NL} || '20121 Milano ' || date end as text
from ({IDS})"""

#: Entities: overlapping spans of four types from two sources; a few equal texts in each document.
ENTITIES = """select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int) as entity_id, cast(l_partkey % 160 as int) as start, cast(l_partkey % 160 + 3 + l_suppkey % 25 as int) as "end",
  case l_linenumber % 5 when 0 then 'EMAIL' when 1 then 'PERSON_NAME' when 2 then 'PHONE' when 3 then 'ADDRESS' else 'IBAN' end as type,
  case l_suppkey % 3 when 0 then 'Anna  Muster' when 1 then 'ANNA muster' else 'Name ' || cast(l_partkey % 4 as string) end as text,
  cast(l_quantity as double) / 50 as confidence, case l_partkey % 2 when 0 then 'ML' else 'RULE' end as source
from {lineitem}"""
ENTITIES_SPARK = ENTITIES.replace('"end"', "end")

#: A log of corrections.
CORRECTIONS = """select event_id as id, ts, case when event_id % 3 = 0 then 'ADD' else 'DISMISS' end as action,
  case event_id % 4 when 0 then 'EMAIL' when 1 then 'PERSON_NAME' when 2 then 'PHONE' else 'DATE' end as entity_type,
  case when event_id % 5 = 0 then null else 'ML' end as source, case when event_id % 7 = 0 then null else value / 100 end as confidence,
  'word ' || cast(user_id % 50 as string) as text, user_id % 40 as document
from {events}"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, TEXTS)


def dealt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts, dealt over the shuffle partitions by their keys, which are all that is shuffled: a text is many times its key, so that a file of few splits
    would leave all work on the texts to few tasks."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return derived(spark, sf_dir, TEXTS, customer=table(spark, sf_dir, "customer").select(K).repartition(n, K))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, IDS)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ENTITIES_SPARK)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, CORRECTIONS)


IDS_SQL, TEXTS_SQL, ENTITIES_SQL, CORRECTIONS_SQL = in_sql(IDS), in_sql(TEXTS), in_sql(ENTITIES), in_sql(CORRECTIONS)
