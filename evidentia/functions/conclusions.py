"""Three readings of a yes/no conclusion in model text. They disagree on purpose; each has its users."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import last_line, strip

# Characters that may wrap a conclusion.
LEADING = r">\s`*_~\"'()\-–—"
TRAILING = r"\s`*_~\"'()\-–—.!?"
AROUND = r"*`_~'\"()\[\]{}<>\-–—.!?:;"


def strict(c: Column) -> Column:
    """Yes or No by the first yes/no/true/false word of the last non-empty line, wrappers aside; else null."""
    line = F.regexp_replace(F.regexp_replace(last_line(c), f"(?U)^[{LEADING}]+", ""), f"(?U)[{TRAILING}]+\\z", "")
    word = F.lower(F.regexp_extract(line, r"(?iU)\b(yes|no|true|false)\b", 1))
    return F.when(word.isin("yes", "true"), "Yes").when(word.isin("no", "false"), "No")


def _token(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(last_line(c)), f"^[{AROUND}]+|[{AROUND}]+$", ""))


def exact(c: Column) -> Column:
    """Yes or No if the last non-empty line is that word alone, wrappers aside; else null."""
    t = _token(c)
    return F.when(t == "yes", "Yes").when(t == "no", "No")


def exact_truth(c: Column) -> Column:
    """1 or 0 if the last non-empty line is True or False alone, wrappers aside; else null."""
    t = _token(c)
    return F.when(t == "true", 1).when(t == "false", 0)


def _anywhere(c: Column, words: str) -> Column:
    first = F.nullif(F.regexp_extract(c, rf"(?iU)Final answer:\s*({words})\b", 1), F.lit(""))
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?iU)\b({words})\b"), F.lit(1)), F.lit(-1))
    return F.lower(F.coalesce(first, last))


def anywhere(c: Column) -> Column:
    """Yes or No by the first "Final answer:", else by the last yes/no word anywhere; else null."""
    return F.initcap(_anywhere(c, "Yes|No"))


def anywhere_truth(c: Column) -> Column:
    """1 or 0 by the first "Final answer:", else by the last true/false word anywhere; else null."""
    t = _anywhere(c, "True|False")
    return F.when(t == "true", 1).when(t == "false", 0)
