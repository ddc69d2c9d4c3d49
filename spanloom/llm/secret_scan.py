"""Secret scan: a trigram inverted index picks the documents that each rule's regular expression can match.

Native: DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import bound, running
from spanloom.llm.common import bounded, exploded, row_key, settled, table


@dataclass(frozen=True)
class Rule:
    """kind: its name. pattern: a regular expression without capturing groups that Java and Python read alike.
    value: the pattern's tail that holds the secret, with at least min_value characters; '' if the whole match counts,
    with at least min_value. fold: ASCII letters of pattern match in either case."""

    kind: str
    pattern: str
    value: str
    min_value: int
    fold: bool = False

    @property
    def regex(self) -> str:
        return f"(?i:{self.pattern})" if self.fold else f"(?:{self.pattern})"

    @property
    def whole(self) -> str:
        return self.regex + (f"(?:{self.value})" if self.value else "")


#: The contract's rules, in the order in which ties are listed. Its least lengths of access and hex stand in the
#: patterns: a run of these characters is matched whole, so a run that is too short holds no match either way.
BASE = (
    Rule("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", "", 16),
    Rule("hex", r"[0-9a-f]{32,}", "", 32),
)
#: Further rules of this operator; formats of public services.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", "", 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", "", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "", 30),
)

#: Most strings that are followed exactly while a query is derived, and most characters of a class that are tried one by one.
MOST_EXACT, MOST_CLASS = 32, 6
ANY = ("all",)


def trigram_query(pattern: str) -> tuple:
    """A Boolean query on the trigrams of the lower-cased text that every match of pattern satisfies:
    ("all",) for anything, ("has", trigram), ("and", ...) or ("or", ...)."""
    exact, query = _needs(parser.parse(pattern))
    return _and([query, _strings(exact)])


def _strings(exact: frozenset[str] | None) -> tuple:
    """One of the strings is in the text. A string whose trigrams include another's adds nothing."""
    if not exact:
        return ANY
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
    return _or([_and([("has", t) for t in sorted(x)]) for x in sorted(sets, key=sorted) if not any(y < x for y in sets)])


def _and(parts: list[tuple]) -> tuple:
    flat = list(dict.fromkeys(q for p in parts for q in (p[1:] if p[0] == "and" else [p]) if q != ANY))
    return ANY if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _or(parts: list[tuple]) -> tuple:
    if ANY in parts:
        return ANY
    flat = list(dict.fromkeys(q for p in parts for q in (p[1:] if p[0] == "or" else [p])))
    return flat[0] if len(flat) == 1 else ("or", *flat)


def _needs(node) -> tuple[frozenset[str] | None, tuple]:
    """(the strings that it can match, lower-cased, or None if they are too many; what else must be in the text)."""
    exact, queries, broken = frozenset([""]), [], False
    for op, arg in node:
        more, query = _one(op, arg)
        queries.append(query)
        if more is None or len(exact) * len(more) > MOST_EXACT:
            queries.append(_strings(exact))
            exact, broken = more or frozenset([""]), True
        else:
            exact = frozenset(a + b for a in exact for b in more)
    return (None, _and([*queries, _strings(exact)])) if broken else (exact, _and(queries))


def _one(op, arg) -> tuple[frozenset[str] | None, tuple]:
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), ANY
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < MOST_CLASS:
                chars |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (frozenset(chars), ANY) if len(chars) <= MOST_CLASS else (None, ANY)
    if op is C.SUBPATTERN:
        return _needs(arg[-1])
    if op is C.BRANCH:
        parts = [_needs(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_EXACT and all(q == ANY for _, q in parts):
            return frozenset().union(*(e for e, _ in parts)), ANY
        return None, _or([_and([q, _strings(e)]) for e, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _needs(inner)
        if (low, high) == (0, 1) and exact is not None and query == ANY:
            return exact | {""}, ANY
        if low == high == 1:
            return exact, query
        return None, _and([query, _strings(exact)]) if low else ANY
    if op is C.AT:
        return frozenset([""]), ANY
    return None, ANY


def trigrams_of(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "has" else set().union(*(trigrams_of(q) for q in query[1:])) if query != ANY else set()


#: Trigrams whose presence one long holds.
WORD = 62
#: Candidates (two hashes and a few rules each) that are broadcast, at most; beyond, the join shuffles.
MOST_BROADCAST = 300_000


def _holds(query: tuple, at: dict[str, int]) -> Column:
    """Whether a document's postings, or-ed into the longs __bits0, __bits1 and so on, satisfy the query."""
    if query == ANY:
        return F.lit(True)
    if query[0] == "has":
        word, bit = divmod(at[query[1]], WORD)
        return F.col(f"__bits{word}").bitwiseAND(F.lit(1 << bit)) != 0
    parts = [_holds(q, at) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def postings(docs: DataFrame, key: Column, text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index, of the trigrams asked for: a row (trigram, key) for each that a text has."""
    # columns of their own: within a generator the planner would lower the text once for each trigram
    rows = docs.select(key.alias("key"), F.lower(F.col(text)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return exploded(rows.select("key", found.alias("found")), F.col("found"), "trigram", "key")


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's matches, leftmost and not overlapping, as an array of (start, kind, end) in code points.

    The text is cut into gaps and matches: \\G ties each to the end of the one before, so the lengths add up to offsets.
    """
    cut = F.lit(rf"\G((?s:.*?))({rule.whole})")
    pairs = F.arrays_zip(F.regexp_extract_all(text, cut, F.lit(1)).alias("g"), F.regexp_extract_all(text, cut, F.lit(2)).alias("m"))
    value = (lambda m: F.regexp_replace(m, "^" + rule.regex, "")) if rule.value else (lambda m: m)

    def one(x: Column, at: Column) -> Column:
        start = at + F.length(x["g"])
        return F.when(F.length(value(x["m"])) >= rule.min_value, F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end")))

    found = bound(pairs, lambda r: F.array_compact(F.zip_with(r, running(F.transform(r, lambda x: F.length(x["g"]) + F.length(x["m"]))), one)))
    return F.when(text.rlike(rule.whole), found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with a column spans: array of (start, kind, end), sorted; kind is the name of the rule.

    Each rule's mandatory trigrams are derived from its regular expression. The postings of all trigrams that some rule
    asks for are intersected for each document by or-ing bits, pre-aggregated before the shuffle. Only documents that
    satisfy a rule's query are verified by its regular expression; rules without mandatory trigrams scan fully.
    Null and empty text: no spans. Repeated rows and ids, also null ids: each row has its own text's spans. An empty table gives no rows. Further
    columns stay; spans, __key and __rules are replaced. A text of any length is scanned whole. Texts are shuffled only if candidates are many.
    """
    queries = [trigram_query(r.whole) for r in rules]
    trigrams = sorted(set().union(*(trigrams_of(q) for q in queries)))
    at = {t: i for i, t in enumerate(trigrams)}
    index = postings(docs, row_key(id_col, text_col), text_col, trigrams)
    wanted = F.array(*[F.when(_holds(q, at), F.lit(i)) for i, q in enumerate(queries) if q != ANY])
    words = [
        F.coalesce(F.bit_or(F.when(F.floor(F.col("trigram") / WORD) == w, F.expr(f"shiftleft(1L, trigram - {w * WORD})"))), F.lit(0)).alias(f"__bits{w}")
        for w in range(-(-len(trigrams) // WORD) or 1)
    ]
    hits = index.groupBy(F.col("key").alias("__key")).agg(*words)
    hits = settled(hits.select("__key", F.array_compact(wanted).alias("__rules")).where(F.size("__rules") > 0), "candidates")
    keyed = docs.drop("spans", "__key", "__rules").withColumn("__key", row_key(id_col, text_col)).join(bounded(hits, MOST_BROADCAST), "__key", "left")
    full = [spans_of(F.col(text_col), r, i) for i, (r, q) in enumerate(zip(rules, queries, strict=True)) if q == ANY]
    some = [F.when(F.array_contains("__rules", F.lit(i)), spans_of(F.col(text_col), r, i)) for i, (r, q) in enumerate(zip(rules, queries, strict=True)) if q != ANY]
    spans = F.array_sort(F.flatten(F.array_compact(F.array(*full, *some))))
    names = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    return keyed.withColumn("spans", F.coalesce(named, F.array().cast("array<struct<start:int,kind:string,end:int>>"))).drop("__key", "__rules")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document, as counts, a digest of the base spans, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    n = [F.size(F.filter("spans", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *n, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    any_case = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() and c.islower() else c for c in s)
    words = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    head = rf"""(?:{words})["'']?\x20*[:=]\x20*["'']?"""
    kinds = [
        ("assign", 0, head + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{head}', '')) >= 8"),
        ("access", 1, "AKIA[A-Z0-9]{12,}", "length(m) >= 16"),
        ("hex", 2, "[0-9a-f]{32,}", "length(m) >= 32"),
        *((r.kind, 3 + i, re.sub(r"'", "''", r.pattern), f"length(m) >= {r.min_value}") for i, r in enumerate(MORE)),
    ]
    parts = "\nunion all ".join(
        f"""select rid, '{k}' as kind, {n} as k, b as s, b + length(m) as e from (
  select rid, unnest(ms) as m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
      list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) as b
  from (select rid, regexp_extract_all(t, '(?s)(.*?)({p})', 1) as gs, regexp_extract_all(t, '(?s)(.*?)({p})', 2) as ms
        from d where regexp_matches(t, '{p}'))) where {c}"""
        for k, n, p, c in kinds
    )
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
s as (select rid, kind, k, s::bigint as s, e::bigint as e from ({parts})),
g as (select rid, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as c, count(*) filter (kind = 'hex') as h,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as al from s group by rid)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(al, '') as spans from d left join g using (rid)"""


ORACLE = _oracle()
