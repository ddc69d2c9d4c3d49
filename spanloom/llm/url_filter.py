"""URL filter: rules on host and path, and block decisions that spread over redirects and canonical links.

Native: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import ascii_lower, settled, table
from spanloom.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    """verdict: allow or block. It fits host and its subdomains, where the url's path starts with path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    UrlRule("allow", "com"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: Rules that stand in the plan itself; longer lists are joined by host suffix.
MOST_INLINE = 200


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(df: DataFrame, url_col: str, rules: tuple[UrlRule, ...]) -> DataFrame:
    """df with host, path, rule and ruling: of the rules that fit, the longest; of equally long ones an allow."""
    out = df.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    if len(ordered) <= MOST_INLINE:
        fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        first = F.coalesce(*[F.when(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("ruling"))) for r in ordered], F.lit(None))
        return out.withColumn("__r", first).withColumns({"rule": F.col("__r.rule"), "ruling": F.col("__r.ruling")}).drop("__r")
    spark = df.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.name, r.verdict, i) for i, r in enumerate(ordered)], "suffix string, rule_path string, rule string, ruling string, rank int")
    labels = F.split("host", r"\.")
    pairs = out.select("host", "path").distinct()
    pairs = pairs.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    best = pairs.join(listed, "suffix").where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.min_by(F.struct("rule", "ruling"), "rank").alias("__r"))
    return out.join(best, ["host", "path"], "left").withColumns({"rule": F.col("__r.rule"), "ruling": F.col("__r.ruling")}).drop("__r")


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
#: Character references that urls in HTML hold.
REFERENCES = (("&#38;", "&"), ("&#x26;", "&"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&quot;", '"'), ("&amp;", "&"))
LINK_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
LINK_URL = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?is)\burl\s*=\s*['"]?\s*([^"'\s>;]+)"""


def resolved(base: Column, target: Column) -> Column:
    """The url that a link to target on the page base leads to; null for links within the page, for other schemes (mailto:) and where
    base isn't an absolute url."""
    for reference, char in REFERENCES:
        target = F.replace(target, F.lit(reference), F.lit(char))
    origin = F.regexp_extract(base, _SCHEME[:-1] + r"/[^/?#]*", 0)
    path = F.regexp_extract(base, _SCHEME + r"[^/?#]*([^?#]*)", 2)
    folder = F.regexp_replace(path, "[^/]*$", "")
    relative = (
        F.when(target.startswith("//"), F.concat(F.regexp_extract(base, _SCHEME, 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), target))
    )
    absent = (target == "") | target.startswith("#") | (target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~target.rlike(_SCHEME))
    return F.when(absent | target.isNull(), None).when(target.rlike(_SCHEME), target).when(origin != "", relative)


def normal_url(url: Column) -> Column:
    """url as links name it: scheme and host in lower case, no fragment, a path without dot segments, / for an empty one. Other strings, and null,
    stay."""
    head = ascii_lower(F.regexp_extract(url, _SCHEME + r"[^/?#]*", 0))
    path = F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 2)
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    step = lambda a, x: F.when(x == ".", a).when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), x))
    folded = F.concat(F.aggregate(parts, F.lit(""), step), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    path = F.when(path.contains("/."), F.when(folded == "", "/").otherwise(folded)).when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(url.rlike(_SCHEME), F.concat(head, path, query)).otherwise(url)


def declared_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): from a page's url to each of its canonical links and meta refreshes. Relative targets are resolved against the page's url.
    Redirects that a crawl has recorded come in alike, by resolved(url, location)."""
    html, url = F.col(html_col), F.col(url_col)
    targets = lambda word, tag, to: F.when(F.contains(F.lower(html), F.lit(word)), F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, to, 1)))
    both = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (targets("canonical", LINK_TAG, LINK_URL), targets("refresh", REFRESH_TAG, REFRESH_URL))])
    rows = pages.where(url.isNotNull()).select(url.alias("src"), both.alias("to")).where("size(to) > 0")
    links = rows.select("src", F.explode("to").alias("to")).select("src", resolved(F.col("src"), F.col("to")).alias("dst"))
    return links.where("dst is not null and src <> dst")


def filter_urls(pages: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """pages with host, path, rule and verdict.

    links: (src, dst), redirects and canonical links between urls, which are compared as normal_url has them. A url's own rule decides first.
    Without one, it is blocked if a url that is joined to it by links, in either direction and over any number of steps, is blocked by a
    rule and none is expressly allowed; else allowed. Urls that occur in links alone are judged too and pass it on.
    Null urls and urls without :// have an empty host and path, no rule, and are allowed. Repeated rows stay; columns of
    pages named host, path, rule, ruling, verdict, __r, __url or __spread are replaced. Empty tables give no rows, or rules alone. Components
    come from shuffles by node, never by the driver.
    """
    own = ruled(pages.drop("__url", "__spread"), url_col, rules)
    links = links.select(normal_url(F.col("src")).alias("src"), normal_url(F.col("dst")).alias("dst"))
    links = settled(links.where("src <> dst").distinct(), "links")
    if links.isEmpty():
        return own.withColumn("verdict", F.coalesce("ruling", F.lit("allow"))).drop("ruling")
    groups = settled(connected_components(links), "aliases")
    named = ruled(groups, "node", rules)
    judged = named.groupBy("component").agg(F.max(F.coalesce(F.col("ruling") == "block", F.lit(False))).alias("bad"), F.max(F.coalesce(F.col("ruling") == "allow", F.lit(False))).alias("good"))
    bad = settled(groups.join(judged.where("bad and not good"), "component").select(F.col("node").alias("__url"), F.lit(True).alias("__spread")), "blocked")
    own = own.withColumn("__url", normal_url(F.col(url_col))).join(bad, "__url", "left")
    return own.withColumn("verdict", F.coalesce("ruling", F.when(F.col("__spread"), "block"), F.lit("allow"))).drop("ruling", "__spread", "__url")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; the links are those that the pages declare."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages.select("page_id", "url"), declared_links(pages)).select("page_id", "host", "path", "rule", "verdict")


_RULE_SQL = "\n    ".join(
    f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.name} {r.verdict}'"
    for r in sorted(RULES, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
)


def _judged(source: str) -> str:
    return f"""select *, case {_RULE_SQL} end as hit from (select *, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from {source})"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_unescaped(c: str) -> str:
    for reference, char in REFERENCES:
        c = f"replace({c}, {_sql(reference)}, {_sql(char)})"
    return c


def _sql_normal(c: str) -> str:
    path = f"regexp_extract({c}, {_sql(_SCHEME + '[^/?#]*([^?#]*)')}, 2)"
    folded = f"""(list_reduce(list_prepend('', string_split(substr({path}, 2), '/')), lambda a, x: case when x = '.' then a when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end)
    || case when regexp_matches({path}, '/\\.\\.?$') then '/' else '' end)"""
    return f"""case when regexp_matches({c}, {_sql(_SCHEME)}) then {_sql_lower(f"regexp_extract({c}, {_sql(_SCHEME + '[^/?#]*')}, 0)")}
    || case when contains({path}, '/.') then case when {folded} = '' then '/' else {folded} end when {path} = '' then '/' else {path} end
    || regexp_extract({c}, '^[^?#]*(\\?[^#]*)', 1) else {c} end"""


_ORIGIN = f"regexp_extract(src, {_sql(_SCHEME[:-1] + '/[^/?#]*')}, 0)"
_PATH = f"regexp_extract(src, {_sql(_SCHEME + '[^/?#]*([^?#]*)')}, 2)"
ORACLE = f"""with recursive tags as (select url as src, unnest(list_concat(
  list_transform(regexp_extract_all(coalesce(html, ''), {_sql(LINK_TAG)}), lambda x: regexp_extract(x, {_sql(LINK_URL)}, 1)),
  list_transform(regexp_extract_all(coalesce(html, ''), {_sql(REFRESH_TAG)}), lambda x: regexp_extract(x, {_sql(REFRESH_URL)}, 1)))) as raw from pages where url is not null),
hop as (select src, {_sql_unescaped("raw")} as t from tags),
to_ as (select src, case when t = '' or starts_with(t, '#') or (regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') and not regexp_matches(t, {_sql(_SCHEME)})) then null
  when regexp_matches(t, {_sql(_SCHEME)}) then t when {_ORIGIN} = '' then null
  when starts_with(t, '//') then regexp_extract(src, {_sql(_SCHEME)}, 1) || ':' || t when starts_with(t, '/') then {_ORIGIN} || t when starts_with(t, '?') then {_ORIGIN} || {_PATH} || t
  else {_ORIGIN} || case when regexp_replace({_PATH}, '[^/]*$', '') = '' then '/' else regexp_replace({_PATH}, '[^/]*$', '') end || t end as dst from hop),
pair as (select {_sql_normal("src")} as src, {_sql_normal("dst")} as dst from to_ where dst is not null),
link as (select src, dst from pair where src <> dst union select dst, src from pair where src <> dst),
reach(a, b) as (select src, src from link union select r.a, l.dst from reach r join link l on r.b = l.src),
judged as ({_judged("(select distinct b as url from reach)")}),
spread as (select a as url, bool_or(hit like '% block') and not bool_or(coalesce(hit like '% allow', false)) as bad from reach join judged on b = judged.url group by a),
own as ({_judged("pages")})
select page_id, host, path, split_part(hit, ' ', 1) as rule,
  case when hit is not null then split_part(hit, ' ', 2) when coalesce(bad, false) then 'block' else 'allow' end as verdict
from own left join spread on {_sql_normal("own.url")} = spread.url"""
