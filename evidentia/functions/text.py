"""Column functions on text. Patterns use (?U) so that character classes are Unicode, as the inputs are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that ends a line: more than "\n".
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
#: White space of any kind, as Python's string methods see it.
_SPACE = r"[\s\x1C-\x1F]"
_EDGE_SPACE = rf"(?U)^{_SPACE}+|{_SPACE}+\z"
NONE = "(none)"

# The word dropped from name keys, and the header line of a field.
DROPPED_WORD = r"\b,?\s*genetic\b"
HEADER_LINE = r"^\s*#{0,6}\s*%s\s*:?\s*\n+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE_SPACE, "")


def norm_key(c: Column) -> Column:
    """Key for matching names: lower case, the word "genetic" dropped, all but a-z and 0-9 one space. Null gives ''."""
    s = strip(F.lower(F.coalesce(c, F.lit(""))))
    s = F.regexp_replace(s, "(?U)" + DROPPED_WORD, "")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def norm_space_lower(c: Column) -> Column:
    """Lower case with white space squeezed."""
    return F.lower(strip(F.regexp_replace(c, f"(?U){_SPACE}+", " ")))


def label_int(c: Column, kind: str) -> Column:
    """Integer label of a column of type ``kind`` (string, boolean or a number); what is none gives null.

    Strings must be ASCII digits with an optional sign; fractions are cut off.
    """
    if kind == "string":
        s = strip(c)
        return F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("int"))
    if kind == "boolean":
        return c.cast("int")
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c.cast("double")).try_cast("int")


def _trim_blank_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s*\n+", ""), r"(?U)\n+\s*\z", "")


def clean_field(c: Column, header: str | None = None) -> Column:
    """Blank edge lines, an optional leading ``### <header>:`` line and leading blanks removed. Null gives ''."""
    s = _trim_blank_lines(F.coalesce(c, F.lit("")))
    if header:
        s = _trim_blank_lines(F.regexp_replace(s, "(?iU)" + HEADER_LINE % header, ""))
    else:
        s = _trim_blank_lines(s)
    return F.regexp_replace(F.regexp_replace(s, r"^[ \t]+", ""), r"\r+\z", "")


def query_variants(q: Column) -> Column:
    """A name, its part before the first comma, and, with a word "and", what comes before the first "and" anywhere."""
    comma = F.when(F.contains(q, F.lit(",")), strip(F.substring_index(q, ",", 1)))
    both = F.when(F.contains(F.lower(q), F.lit(" and ")), strip(F.substring_index(q, "and", 1)))
    return F.array_distinct(F.filter(F.array(q, comma, both), lambda x: x.isNotNull() & (x != "")))


def split_features(c: Column) -> Column:
    """Comma-separated text as trimmed, non-empty parts. Null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def join_or_none(a: Column, separator: str) -> Column:
    """Parts joined, or "(none)"."""
    joined = F.array_join(F.coalesce(a, F.array().cast("array<string>")), separator)
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, joined).otherwise(F.lit(NONE))


def bullets(a: Column) -> Column:
    """One "- " line per part, or "(none)"."""
    return join_or_none(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")


def between_markers(c: Column, start: str = "<start>", end: str = "<end>") -> Column:
    """What stands between two markers of any case; the whole text without them; null if empty."""
    t = strip(c)
    a, b = F.instr(F.lower(t), start), F.instr(F.lower(t), end)
    inner = strip(F.substr(t, a + F.lit(len(start)), b - a - F.lit(len(start))))
    return F.when((a > 0) & (b > a), inner).otherwise(F.when(t != "", t))


def file_safe(c: Column) -> Column:
    """Runs of anything but word characters and hyphens as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-]+", "_"), "^_+|_+$", "")


def last_line(c: Column) -> Column:
    """The last line with more than white space, trimmed; null if there is none."""
    lines = F.filter(F.transform(F.split(c, LINE_END), strip), lambda x: x != "")
    return F.try_element_at(lines, F.lit(-1))
