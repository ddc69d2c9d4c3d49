"""Queries of extraction and validation, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import validators as v
from spanloom.functions.regex import sql_regex
from spanloom.operators import extract as x
from spanloom.plans.inputs import IDS_SQL, TEXTS_SQL, ids, table, texts

Query = Callable[[SparkSession, str], DataFrame]


def _scan(patterns: tuple[x.Pattern, ...]) -> Query:
    return lambda spark, d: x.extract(texts(spark, d), patterns)


def _validated(column: str, validator: Callable[[Column], Column]) -> Query:
    return lambda spark, d: ids(spark, d).select("doc_id", F.col(column).alias("text"), validator(F.col(column)).alias("r")).select("doc_id", "text", "r.valid", "r.confidence")


def _checked_sql(column: str, arms: list[tuple[str, str, float]], last: tuple[str, float], extra: str = "") -> str:
    valid = " ".join(f"when {c} then {ok}" for c, ok, _ in arms)
    sure = " ".join(f"when {c} then {n}" for c, _, n in arms)
    return f"select doc_id, text, case {valid} else {last[0]} end as valid, (case {sure} else {last[1]} end)::double as confidence from (select *, {column} as text, regexp_replace({column}, '[^0-9]', '', 'g') as d{extra} from {IDS_SQL})"


def _sum(weights: list[int]) -> str:
    return " + ".join(f"coalesce(try_cast(substr(d, {i + 1}, 1) as int), 0) * {w}" for i, w in enumerate(weights))


_MONTHS = "map {" + ", ".join(f"'{k}': {n}" for k, n in v.MONTHS.items()) + "}"
_LENGTHS = "map {" + ", ".join(f"'{k}': {n}" for k, n in v.IBAN_LENGTHS.items()) + "}"
_NUMERIC, _NAMED = r"(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})", r"(\d{1,2})\.?\s*([a-zäöüéè]+)\s*(\d{2,4})"
_listed = lambda xs: ", ".join("'" + s.replace("'", "''") + "'" for s in xs)

_AVS_SQL = _checked_sql("avs", [("length(text) > 20", "false", 0.3), ("length(d) <> 13 or not starts_with(d, '756')", "false", 0.4), (f"try_cast(substr(d, 13, 1) as int) = (10 - ({_sum([1, 3] * 6)}) % 10) % 10", "true", 0.95)], ("false", 0.3))
_IBAN_SQL = f"""with c as (select doc_id, iban as text, upper(regexp_replace(iban, '\\s', '', 'g')) as code from {IDS_SQL}),
n as (select *, array_to_string(list_transform(string_split(substr(code, 5) || left(code, 4), ''), lambda ch: case when ascii(ch) >= 65 then (ascii(ch) - 55)::varchar else ch end), '') as num, {_LENGTHS}[left(code, 2)] as want from c),
m as (select *, (coalesce(try_cast((left(num, 30)::hugeint % 97)::varchar || substr(num, 31, 30) as hugeint), -1) % 97)::varchar || substr(num, 61) as tail from n),
n2 as (select *, coalesce(try_cast(tail as hugeint) % 97, -1) as rest from m)
select doc_id, text, length(code) >= 15 and coalesce(length(code) = want, true) and rest = 1 as valid,
  (case when length(text) > 34 or length(code) < 15 then 0.3 when coalesce(length(code) <> want, false) or rest <> 1 then 0.4 else 0.95 end)::double as confidence from n2"""
_EMAIL_SQL = _checked_sql("email", [(f"length(text) > 254 or not regexp_matches(lower(text), {sql_regex(v.EMAIL)}) or contains(text, '..')", "false", 0.3), ("length(split_part(text, '.', -1)) < 2", "false", 0.4)], ("true", 0.9))
_PHONE_SQL = _checked_sql(
    "phone",
    [("length(text) > 20 or length(d) not between 9 and 15", "false", 0.3), ("not regexp_matches(d, '^(?:00)?(?:41|49|33|39|43|32|31|352)') and not regexp_matches(d, '^0(?:[1-9]|$)')", "false", 0.5), ("regexp_matches(d, '^41(?:76|77|78|79)') or regexp_matches(d, '^0(?:76|77|78|79)')", "true", 0.9)],
    ("true", 0.75),
)
_DATE_SQL = f"""with p as (select doc_id, date as text, case when regexp_matches(date, '{_NUMERIC}') then regexp_extract(date, '{_NUMERIC}', 1)::int else try_cast(regexp_extract(lower(date), '{_NAMED}', 1) as int) end as dd,
  case when regexp_matches(date, '{_NUMERIC}') then regexp_extract(date, '{_NUMERIC}', 2)::int else {_MONTHS}[regexp_extract(lower(date), '{_NAMED}', 2)] end as mm,
  case when regexp_matches(date, '{_NUMERIC}') then regexp_extract(date, '{_NUMERIC}', 3)::int else try_cast(regexp_extract(lower(date), '{_NAMED}', 3) as int) end as yy from {IDS_SQL}),
y as (select *, case when yy >= 100 then yy when yy > 30 then yy + 1900 else yy + 2000 end as year from p),
r as (select *, case when dd is null or mm is null or yy is null then 0.4 when mm not between 1 and 12 then 0.3 when dd not between 1 and day(last_day(make_date(year, greatest(1, least(12, mm)), 1))) then 0.3 when year not between 1900 and 2100 then 0.4 else 0.85 end as c from y)
select doc_id, text, c = 0.85 as valid, c::double as confidence from r"""
_VAT_SQL = _checked_sql("vat", [("length(d) <> 9", "false", 0.4), (f"try_cast(substr(d, 9, 1) as int) = (11 - ({_sum([5, 4, 3, 2, 7, 6, 5, 4])}) % 11) % 11", "true", 0.9)], ("false", 0.5))
_CITY = "lower(regexp_split_to_array(trim(substr(text, 5)), '\\s')[1])"
_ADDRESS_SQL = _checked_sql(
    "address",
    [
        ("regexp_matches(text, '(?i)\\bwww\\b|\\.ch\\b|\\.com\\b|http')", "false", 0.3),
        ("coalesce(try_cast(left(text, 4) as int), 0) not between 1000 and 9999 or length(trim(substr(text, 5))) < 3", "false", 0.3),
        (f"left(text, 4)::int between 1900 and 2099 and {_CITY} in ({_listed(v.YEAR_CITIES)})", "true", 0.82),
        (f"left(text, 4)::int between 1900 and 2099 and {_CITY} in ({_listed(v.MONTHS)})", "false", 0.2),
        (f"left(text, 4)::int between 1900 and 2099 and {_CITY} in ({_listed(v.NOT_CITIES)})", "false", 0.3),
        (f"{_CITY} in ({_listed(v.NOT_CITIES)})", "false", 0.4),
    ],
    ("true", 0.82),
)
_POSTAL_SQL = _checked_sql("left(address, 4)", [("not regexp_full_match(text, '[0-9]{4}')", "false", 0.4), ("text::int between 1000 and 9699", "true", 0.85)], ("false", 0.5))


def _postal(spark: SparkSession, d: str) -> DataFrame:
    code = F.substring("address", 1, 4)
    return ids(spark, d).select("doc_id", code.alias("text"), v.postal_code(code).alias("r")).select("doc_id", "text", "r.valid", "r.confidence")


def x2_person_names(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the name pattern in the texts and documents, and whether they are names."""
    found = x.extract(texts(spark, d), x.HIGH_RECALL[-1:]).unionByName(x.extract(table(spark, d, "documents"), x.HIGH_RECALL[-1:]))
    return found.select("doc_id", "start", "text", x.is_person_name(F.col("text")).alias("is_name"))


def c1_format_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every high-recall entity with its validation: valid ones gain a fifth, at most 1; invalid ones fall to the validator's confidence."""
    return validated(x.extract(texts(spark, d), x.HIGH_RECALL))


def validated(found: DataFrame) -> DataFrame:
    """Entities with status and confidence; types without a validator are unchecked."""
    result = None
    for kind, check in v.VALIDATORS.items():
        arm = F.col("type") == kind
        result = F.when(arm, check(F.col("text"))) if result is None else result.when(arm, check(F.col("text")))
    out = found.withColumn("r", result)
    status = F.when(F.col("r").isNull(), "unchecked").when(F.col("r.valid"), "valid").otherwise("invalid")
    sure = F.when(F.col("r").isNull(), F.lit(x.RULE_CONFIDENCE)).when(F.col("r.valid"), F.round(F.least(F.lit(1.0), F.lit(x.RULE_CONFIDENCE * 1.2)), 4)).otherwise(F.least(F.lit(x.RULE_CONFIDENCE), F.col("r.confidence")))
    return out.withColumns({"status": status, "confidence": sure}).drop("r")


_FOUND_SQL = x.extract_sql("t", x.HIGH_RECALL)
_names = lambda source: x.extract_sql(source, x.HIGH_RECALL[-1:])

QUERIES: dict[str, tuple[Query, str | None]] = {
    "x1_high_recall": (_scan(x.HIGH_RECALL), f"with t as {TEXTS_SQL} select * from {_FOUND_SQL}"),
    "x2_person_names": (x2_person_names, f"with t as {TEXTS_SQL} select doc_id, start, text, {x.is_person_name_sql('text')} as is_name from (select * from {_names('t')} union all select * from {_names('documents')})"),
    "x3_detector": (_scan(x.DETECTOR), f"with t as {TEXTS_SQL} select * from {x.extract_sql('t', x.DETECTOR)}"),
    "v1_swiss_avs": (_validated("avs", v.swiss_avs), _AVS_SQL),
    "v2_iban": (_validated("iban", v.iban), _IBAN_SQL),
    "v3_email": (_validated("email", v.email), _EMAIL_SQL),
    "v4_phone": (_validated("phone", v.phone), _PHONE_SQL),
    "v5_date": (_validated("date", v.date), _DATE_SQL),
    "v6_swiss_address": (_validated("address", v.swiss_address), _ADDRESS_SQL),
    "v7_postal_code": (_postal, _POSTAL_SQL),
    "v8_vat": (_validated("vat", v.vat), _VAT_SQL),
}
_CHECKS = {"SWISS_AVS": _AVS_SQL, "IBAN": _IBAN_SQL, "EMAIL": _EMAIL_SQL, "PHONE": _PHONE_SQL, "DATE": _DATE_SQL, "VAT_NUMBER": None, "SWISS_ADDRESS": _ADDRESS_SQL}
_COLUMN = {"SWISS_AVS": "avs", "IBAN": "iban", "EMAIL": "email", "PHONE": "phone", "DATE": "date", "SWISS_ADDRESS": "address"}
_EU_VAT = "(select text, not starts_with(upper(text), 'CHE') as eu from f where type = 'VAT_NUMBER')"


def _c1_sql() -> str:
    """The validators' SQL, run over the distinct found texts instead of the ids."""
    parts = [f"select text, '{kind}' as type, valid, confidence from ({sql.replace(IDS_SQL, f'(select 0 as doc_id, text as {_COLUMN[kind]} from f where type = ' + chr(39) + kind + chr(39) + ' group by text)')})" for kind, sql in _CHECKS.items() if sql]
    swiss = _VAT_SQL.replace(IDS_SQL, "(select 0 as doc_id, text as vat from f where type = 'VAT_NUMBER' and starts_with(upper(text), 'CHE') group by text)")
    other = "select text, 'VAT_NUMBER' as type, regexp_matches(upper(regexp_replace(text, '\\s', '', 'g')), '^(DE|FR|IT|AT)\\d{8,11}$') as valid, 0.4 as confidence from f where type = 'VAT_NUMBER' and not starts_with(upper(text), 'CHE') group by text"
    checks = " union all ".join([*parts, f"select text, 'VAT_NUMBER' as type, valid, confidence from ({swiss})", other])
    return f"""with t as {TEXTS_SQL}, f as materialized (select * from {_FOUND_SQL}), c as ({checks})
select f.*, case when c.valid is null then 'unchecked' when c.valid then 'valid' else 'invalid' end as status,
  (case when c.valid is null then 0.7 when c.valid then 0.84 else least(0.7, c.confidence) end)::double as confidence from f left join c on f.text = c.text and f.type = c.type"""


QUERIES["c1_format_validation"] = (c1_format_validation, _c1_sql())
