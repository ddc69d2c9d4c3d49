"""Repair of text from page layouts, and Markdown pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.regex import spark_regex, sql_regex

# The repairs of merged words, in order: (pattern, replacement, whether case is folded).
MERGED = [
    (r"([,.:;])([A-ZÀ-Ÿa-zà-ÿ])", r"\1 \2", False), (r"(['\")\]])([A-ZÀ-Ÿa-zà-ÿ])", r"\1 \2", False), (r"([A-ZÀ-Ÿa-zà-ÿ])(['\"(\[])", r"\1 \2", False), (r"([a-zà-ÿ])([A-ZÀ-ÖØ-Þ])", r"\1 \2", False),
    (r"([a-zà-ÿ]{2,})à(\s|[A-ZÀ-ÖØ-Þ])", r"\1 à\2", False), (r"(\s|^)à([a-zà-ÿ]{2,})", r"\1à \2", False), (r"(\d{4,5})([A-ZÀ-Ÿ][a-zà-ÿ]+)", r"\1 \2", False), (r"([A-Za-zà-ÿ])(\d{1,4})(\s|$)", r"\1 \2\3", False),
    (r"\bNotreréférence\b", "Notre référence", False), (r"\bCasepostale\b", "Case postale", False), (r"\bAssurancesvie\b", "Assurances vie", False), (r"\bCheminde\b", "Chemin de", False),
    (r"\bFondationcollective\b", "Fondation collective", False), (r"\bTél\.direct\b", "Tél. direct", False), (r"\badhésionno\b", "adhésion no", True), (r"\bContratno\b", "Contrat no", True),
    (r"\+41(\d{2})(\d{3})(\d{2})(\d{2})", r"+41 \1 \2 \3 \4", False), (r"www\.\s+", "www.", False), (r"\.\s+ch\b", ".ch", False), (r"\.\s+com\b", ".com", False), (r"\s+@", "@", False), (r"@\s+", "@", False), (r"  +", " ", False),
]
# What code looks like.
CODE = [r"function\s+\w+\s*\(", r"class\s+\w+", r"import\s+.+from", r"const\s+\w+\s*=", r"let\s+\w+\s*=", r"var\s+\w+\s*=", r"(?s)\{.*\}", r"\[\s*\]"]


# Words that extraction has broken, accents and elisions that it has torn off, endings that a word's last piece makes, and short words that stay apart.
BROKEN = [("mes dames", "mesdames"), ("mes sie urs", "messieurs"), ("da mes", "dames"), ("sie urs", "sieurs")]
TORN = [
    (r"([a-zà-öø-ÿ])\s+([éèêëàâäùûüôöïî][a-zà-öø-ÿ]+)", r"\1\2", True), (r"\b([dlncmtsqjDLNCMTSQJ])\s*['\x{2019}\x{02BC}]\s*([a-zA-Zà-öø-ÿÀ-ÖØ-Ÿ])", r"\1'\2", False),
    (r"\b(qu|Qu|QU)\s*['\x{2019}\x{02BC}]\s*([a-zA-Zà-öø-ÿÀ-ÖØ-Ÿ])", r"\1'\2", False),
]
ENDINGS = ["ment", "tion", "sion", "eurs", "ieurs", "teur", "trice", "ance", "ence", "elle", "esse", "ante", "ente", "able", "ible"]
APART = [
    "le", "la", "de", "du", "un", "et", "ou", "en", "au", "à", "ne", "se", "ce", "me", "te", "es", "je", "tu", "il", "par", "sur", "pour", "dans", "avec", "sans", "sous", "vous", "nous", "elle", "pas", "est", "sont",
    "der", "die", "das", "den", "dem", "des", "ein", "und", "von", "mit", "für", "bei", "aus",
]
PAIR_LONG, PAIR_SHORT = r"\b[a-zà-öø-ÿ]{2,}\s+[a-zà-öø-ÿ]{1,5}\b", r"\b[a-zà-öø-ÿ]{2,4}\s+[a-zà-öø-ÿ]{2,4}\b"


def map_matches(text: Column, pattern: str, change) -> Column:
    """text with change(match) for each match of pattern, leftmost and not overlapping."""
    p = spark_regex(pattern)
    hits = F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), change)
    return F.array_join(F.zip_with(F.split(text, p, -1), F.array_append(hits, F.lit("")), lambda a, b: F.concat(a, b)), "")


def map_matches_sql(text: str, pattern: str, change: str) -> str:
    """The same in SQL; change is an expression of m."""
    p = sql_regex(pattern)
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, {p}), list_append(list_transform(regexp_extract_all({text}, {p}), lambda m: {change}), '')), lambda z: z[1] || z[2]), '')"


def join_broken(text: Column) -> Column:
    """Words that extraction has broken in two are joined again: known ones, torn accents and elisions, pieces that make a common ending, and two short pieces none of which
    is a word that stands alone."""
    for broken, whole in BROKEN:
        text = F.regexp_replace(text, spark_regex(broken.replace(" ", r"\s+"), fold=True), whole)
    for pattern, new, fold in TORN:
        text = F.regexp_replace(text, spark_regex(pattern, fold), new.replace("\\", "$"))
    joined = lambda m: F.regexp_replace(m, spark_regex(r"\s+"), "")
    text = map_matches(text, PAIR_LONG, lambda m: F.when(joined(m).rlike("(?:" + "|".join(ENDINGS) + ")$"), joined(m)).otherwise(m))
    parts = lambda m: F.split(m, spark_regex(r"\s+"), -1)
    return map_matches(text, PAIR_SHORT, lambda m: F.when(F.exists(parts(m), lambda w: w.isin(*APART)), m).otherwise(joined(m)))


def join_broken_sql(text: str) -> list[str]:
    """The steps of join_broken as expressions of text, to be nested as subqueries."""
    steps = [f"regexp_replace(text, {sql_regex(broken.replace(' ', chr(92) + 's+'), fold=True)}, '{whole}', 'g')" for broken, whole in BROKEN]
    steps += [f"regexp_replace(text, {sql_regex(pattern, fold)}, '{new.replace(chr(39), chr(39) * 2)}', 'g')" for pattern, new, fold in TORN]
    joined = f"regexp_replace(m, {sql_regex(chr(92) + 's+')}, '', 'g')"
    steps.append(map_matches_sql("text", PAIR_LONG, f"case when regexp_matches({joined}, '(?:{'|'.join(ENDINGS)})$') then {joined} else m end"))
    listed = ", ".join(f"'{w}'" for w in APART)
    steps.append(map_matches_sql("text", PAIR_SHORT, f"case when len(list_filter(regexp_split_to_array(m, {sql_regex(chr(92) + 's+')}), lambda w: w in ({listed}))) > 0 then m else {joined} end"))
    return steps


def split_merged(text: Column) -> Column:
    """Spaces where words, numbers and signs have run together, none within addresses of pages and mails."""
    for pattern, new, fold in MERGED:
        text = F.regexp_replace(text, spark_regex(pattern, fold), new.replace("\\", "$"))
    return text


def split_merged_sql(text: str) -> str:
    for pattern, new, fold in MERGED:
        text = f"regexp_replace({text}, {sql_regex(pattern, fold)}, '{new}', 'g')"
    return text


def title_case(text: Column) -> Column:
    """Each word's first letter large, the others small; words begin at ASCII word characters and end at spaces."""
    pieces = F.regexp_extract_all(text, F.lit(r"\w\S*|\W"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 10_000)))), "")


def looks_like_code(text: Column) -> Column:
    found = F.lit(False)
    for p in CODE:
        found = found | text.rlike(spark_regex(p))
    return found


def looks_like_code_sql(text: str) -> str:
    return "(" + " or ".join(f"regexp_matches({text}, {sql_regex(p)})" for p in CODE) + ")"


def quoted(text: Column) -> Column:
    return F.concat(F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("> "), x)), "\n"), F.lit("\n\n"))


def heading(text: Column, level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level))), F.lit(" "), text, F.lit("\n\n"))


def ending(name: Column) -> Column:
    """The lower-case ending of a file's name with its dot, or nothing."""
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1)))).otherwise("")
