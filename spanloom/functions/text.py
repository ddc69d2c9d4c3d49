"""Text transforms: normalisation, keys, lemmas, Markdown, previews, language and log cleaning, as native expressions."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.regex import spark_regex, sql_regex

# Characters without width, and spaces that are written as one space.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
ODD_SPACES = "\u00a0\u2007\u202f"

# Obfuscated signs of e-mail addresses, in the order in which they are replaced.
EMAIL_SIGNS = [
    (r"\s*\(at\)\s*", "@"), (r"\s*\[at\]\s*", "@"), (r"\s*\{at\}\s*", "@"), (r"\s*\(dot\)\s*", "."), (r"\s*\[dot\]\s*", "."), (r"\s*\{dot\}\s*", "."), (r"\s*\(arobase\)\s*", "@"),
    (r"\s*arobase\s*", "@"), (r"\s*\(point\)\s*", "."), (r"\s*point\s+", "."), (r"\s*\(Klammeraffe\)\s*", "@"), (r"\s*Klammeraffe\s*", "@"), (r"\s*\(Punkt\)\s*", "."),
]

# Suffix rules by language, (suffix, its replacement, least length of the word's rest), first fit wins.
LEMMA_RULES = {
    "en": [("resses", "ress", 4), ("nesses", "ness", 4), ("ations", "ation", 5), ("ements", "ement", 5), ("ments", "ment", 4), ("ings", "ing", 4), ("sses", "ss", 4), ("ies", "y", 3), ("ves", "fe", 4), ("es", "e", 4), ("ed", "", 4), ("ss", "ss", 3), ("s", "", 4)],
    "fr": [("ations", "ation", 5), ("ements", "ement", 5), ("ments", "ment", 4), ("euses", "euse", 4), ("eurs", "eur", 4), ("eaux", "eau", 4), ("aux", "al", 3), ("es", "", 3), ("s", "", 3)],
    "de": [("ungen", "ung", 4), ("heiten", "heit", 4), ("keiten", "keit", 4), ("ieren", "ieren", 5), ("nummern", "nummer", 6), ("ssen", "ss", 4), ("en", "", 3), ("er", "", 3), ("e", "", 3), ("n", "", 3), ("s", "", 3)],
}

# Words that tell a text's language; ties go to the first.
LANGUAGE_WORDS = {
    "de": ["und", "der", "die", "das", "ist", "für", "mit", "von", "strasse"],
    "fr": ["et", "le", "la", "les", "de", "du", "des", "pour", "rue", "avec"],
    "en": ["the", "and", "of", "to", "in", "is", "for", "with", "street"],
}

# What is taken off Markdown, in order: (pattern, replacement). A marker's pair is written out for each marker.
MARKDOWN = [
    (r"(?m)\A---\n(?s:.*?)\n---\n", ""), (r"(?m)^#{1,6}\s+(.*)$", r"\1"), (r"\*\*(.*?)\*\*", r"\1"), (r"__(.*?)__", r"\1"), (r"\*(.*?)\*", r"\1"), (r"_(.*?)_", r"\1"), (r"`([^`]+)`", r"\1"),
    (r"(?s)```.*?```", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"(?m)^[-*_]{3,}$", ""), (r"\|", " "), (r"(?m)^[-:| ]+$", ""), (r"(?m)^[\s]*[-*+]\s+", ""),
    (r"(?m)^[\s]*\d+\.\s+", ""), (r"(?m)^>\s+", ""), (r"\n{3,}", "\n\n"),
]


@functools.lru_cache(1 << 16)
def _joins(a: str, b: str) -> bool:
    """Whether b may be composed with what a ends: it is a combining mark, or both together become something else, as Hangul jamo do."""
    if b < "\x80":
        return False
    norm = lambda x: unicodedata.normalize("NFKC", x)
    return bool(unicodedata.combining(b)) or norm(norm(a) + norm(b)) != norm(a) + norm(b)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("index_map", T.ArrayType(T.IntegerType()))]))
def _normalised(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        out = []
        for t in s:
            pieces, places, start = [], [], 0
            text = t or ""
            for i in range(1, len(text) + 1):
                if i == len(text) or not _joins(text[start:i], text[i]):
                    piece = unicodedata.normalize("NFKC", text[start:i])
                    pieces.append(piece)
                    places += [start] * len(piece)
                    start = i
            out.append(("".join(pieces), [*places, len(text)]))
        yield pd.DataFrame(out, columns=["text", "index_map"])


def normalise_unicode(text: Column) -> Column:
    """(text, index_map): NFKC, with the original place of each code point and the original length at last. Only texts that aren't
    ASCII reach Python."""
    plain = F.struct(text.alias("text"), F.sequence(F.lit(0), F.length(text)).alias("index_map"))
    return F.when(text.rlike(r"[^\x00-\x7F]"), _normalised(F.when(text.rlike(r"[^\x00-\x7F]"), text))).when(text.isNotNull(), plain)


def map_span(index_map: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The original span of a normalised one: an empty span stays at its start; the end follows the last character's place."""
    at = F.element_at(index_map, start + 1)
    return at, F.when(end <= start, at).otherwise(F.element_at(index_map, end) + 1)


def normalise_spaces(text: Column) -> Column:
    return F.translate(F.translate(text, ZERO_WIDTH, ""), ODD_SPACES, "   ")


def reveal_emails(text: Column) -> Column:
    for pattern, sign in EMAIL_SIGNS:
        text = F.regexp_replace(text, spark_regex(pattern, fold=True), sign)
    return text


def reveal_phones(text: Column) -> Column:
    return F.regexp_replace(text, spark_regex(r"(\+\d{1,3})\s*\(0\)\s*"), "$1 ")


def text_key(text: Column) -> Column:
    """Lower case, one space between words, none outside."""
    return F.btrim(F.regexp_replace(F.lower(text), spark_regex(r"\s+"), " "))


def city_key(text: Column) -> Column:
    return F.replace(F.translate(F.btrim(F.lower(text)), "äàâéèêëîïìöôòüùûç", "aaaeeeeiiiooouuuc"), F.lit("ß"), F.lit("ss"))


def postal_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(text), r"^CH[-\s]?", ""), r"\s", "")


def lemma(word: Column, language: str = "en") -> Column:
    """The word without its inflection: the first suffix that fits with enough of the word before it."""
    low = F.lower(word)
    out = None
    for suffix, new, least in LEMMA_RULES[language]:
        fits = low.endswith(suffix) & (F.length(word) - len(suffix) >= least)
        made = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(new))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return F.when(F.length(word) < 3, word).otherwise(out.otherwise(word))


def lemma_sql(word: str, language: str = "en") -> str:
    arms = " ".join(f"when ends_with(lower({word}), '{s}') and length({word}) - {len(s)} >= {n} then left({word}, length({word}) - {len(s)}) || '{r}'" for s, r, n in LEMMA_RULES[language])
    return f"case when length({word}) < 3 then {word} {arms} else {word} end"


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, or the words if they are more."""
    words = F.size(F.array_remove(F.split(text, r"\s+"), ""))
    return F.greatest(F.ceil(F.length(text) / 4).cast("int"), words)


def language(text: Column) -> Column:
    """The language whose words are most frequent in the first 2,000 characters; ties in the order of the table."""
    sample = F.lower(F.substring(text, 1, 2000))
    counts = [F.struct(F.regexp_count(sample, F.lit(spark_regex(rf"\b(?:{'|'.join(words)})\b"))).alias("n"), F.lit(-i).alias("rank"), F.lit(lang).alias("lang")) for i, (lang, words) in enumerate(LANGUAGE_WORDS.items())]
    return F.array_max(F.array(*counts))["lang"]


def language_sql(text: str) -> str:
    count = lambda words: "len(regexp_extract_all(lower(left({t}, 2000)), " + sql_regex(rf"\b(?:{'|'.join(words)})\b") + "))"
    n = {k: count(v).format(t=text) for k, v in LANGUAGE_WORDS.items()}
    return f"case when {n['de']} >= greatest({n['fr']}, {n['en']}) then 'de' when {n['fr']} >= {n['en']} then 'fr' else 'en' end"


def strip_markdown(text: Column) -> Column:
    for pattern, new in MARKDOWN:
        text = F.regexp_replace(text, pattern, new.replace("\\1", "$1"))
    return F.btrim(text, F.lit(" \n\r\t"))


def strip_markdown_sql(text: str) -> str:
    for pattern, new in MARKDOWN:
        p = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{p}', '{new}', 'g')" if "\n" not in new else f"regexp_replace({text}, '{p}', chr(10) || chr(10), 'g')"
    return f"trim({text}, ' ' || chr(10) || chr(13) || chr(9))"


# What the log cleaner replaces, in order.
LOG_MARKS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b", "[IBAN]"), (r"\b756\.\d{4}\.\d{4}\.\d{2}\b", "[AVS]"),
    (r"(?:\+|00)\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}", "[PHONE]"), (r"\b\d{4,5}[ ]+[A-Z][a-z]{2,}\b", "[POSTAL]"),
]


def clean_log(text: Column, original: Column | None = None) -> Column:
    """The text without the original (if given) and without what looks like personal data."""
    if original is not None:
        text = F.when(F.length(original) > 0, F.replace(text, original, F.lit("[ENTITY]"))).otherwise(text)
    for pattern, mark in LOG_MARKS:
        text = F.regexp_replace(text, spark_regex(pattern), mark.replace("$", "\\$"))
    return text


def clean_log_sql(text: str) -> str:
    for pattern, mark in LOG_MARKS:
        text = f"regexp_replace({text}, {sql_regex(pattern)}, '{mark}', 'g')"
    return text


def preview(text: Column, lines: int = 20, chars: int = 1000, mark: str = "\n[...]") -> Column:
    """The first lines, then the first characters, and a mark if something is left out."""
    head = F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")
    return F.when((F.length(head) > chars) | (F.length(head) < F.length(text)), F.concat(F.substring(head, 1, chars), F.lit(mark))).otherwise(head)


def text_counts(text: Column) -> Column:
    """(lines, words, chars); a last empty line doesn't count."""
    lines = F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)
    return F.struct(lines.alias("lines"), F.size(F.array_remove(F.split(text, r"\s+"), "")).alias("words"), F.length(text).alias("chars"))


def fuzzy_pattern(text: Column) -> Column:
    """A pattern that finds text with up to two other signs between its letters; null for long, or too short ones."""
    clean = F.regexp_replace(text, r"[^\w]", "")
    found = F.array_join(F.split(clean, ""), "[^a-zA-Z0-9]{0,2}?")
    return F.when((F.length(text) <= 50) & F.length(clean).between(3, 30), found)


def regex_risk(pattern: Column) -> Column:
    """A score of how slow a pattern may be: nested and unbounded quantifiers, repeated classes, alternatives, length."""
    count = lambda p: F.regexp_count(pattern, F.lit(p))
    return 10 * count(r"\([^)]*[+*][^)]*\)[+*]") + 5 * count(r"[+*](?!\?)") + 3 * count(r"\[[^\]]+\][+*]") + 2 * count(r"\|") + F.length(pattern) / 50


# Titles before a name, in the order in which they are taken off; a full stop stands for any sign.
TITLES = ["mr", "mr.", "herr", "m.", "monsieur", "mister", "mrs", "mrs.", "frau", "mme", "mme.", "madame", "ms", "ms.", "fräulein", "mlle", "mademoiselle", "dr", "dr.", "doktor", "docteur", "prof", "prof.", "professor", "professeur"]


def title_key(text: Column) -> Column:
    """The text's key without titles before it."""
    key = text_key(text)
    for title in TITLES:
        key = F.regexp_replace(key, spark_regex(rf"^{title}\s+", fold=True), "")
    return F.btrim(key)


def title_key_sql(key: str) -> str:
    for title in TITLES:
        key = f"regexp_replace({key}, {sql_regex(rf'^{title}{chr(92)}s+', fold=True)}, '')"
    return f"trim({key})"


def regex_escaped(text: Column) -> Column:
    """The text with a backslash before each sign that patterns read."""
    return F.regexp_replace(text, r"[.*+?^${}()|\[\]\\]", r"\\$0")


#: Characters of a text that a guarded pattern looks at, at most; a longer text has an error instead of an answer.
GUARD = 10_000


def guarded(text: Column, pattern: str, most: int = GUARD) -> Column:
    """(success, value, error): whether the pattern stands in a text of most characters or fewer; longer texts aren't searched."""
    fits = F.length(text) <= most
    error = F.when(~fits, F.concat(F.lit("Input exceeds maximum length ("), F.length(text).cast("string"), F.lit(f" > {most})")))
    return F.struct(fits.alias("success"), F.when(fits, text.rlike(spark_regex(pattern))).alias("value"), error.alias("error"))
