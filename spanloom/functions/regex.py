"""Regular expressions in the library's own dialect, for Spark and for the SQL that tests hold it against.

A pattern is written with ASCII \\w and \\d, a \\b between ASCII word characters and others, and a \\s that also means no-break
space, line and paragraph separators and the byte order mark. Spark's \\b counts other letters as word characters and its \\s is
ASCII, so both are spelt out.
"""

from __future__ import annotations

_SPACES = r"\s\x{a0}\x{2028}\x{2029}\x{feff}"
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _spelt(pattern: str, edge: str) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACES if inside else f"[{_SPACES}]")
        elif two == r"\b" and not inside:
            out.append(edge)
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = (two[0] == "[") if not inside else two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def spark_regex(pattern: str, fold: bool = False) -> str:
    """The pattern for Spark; fold: letters match in either case."""
    return ("(?iu)" if fold else "") + _spelt(pattern, _EDGE)


def sql_regex(pattern: str, fold: bool = False) -> str:
    """The pattern as an SQL string literal for an engine with RE2 syntax."""
    return "'" + (("(?i)" if fold else "") + _spelt(pattern, r"\b")).replace("'", "''") + "'"
