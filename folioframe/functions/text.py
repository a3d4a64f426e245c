"""Text predicates and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that speak for English text.
ENGLISH_WORDS = (
    "a an and at built by developed education engineer experience for from in intern of on project projects "
    "resume role skills software summary technical the to university using with work"
).split()


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Without (cid:n) marks and control characters, one space for white space, none before a comma."""
    c = F.regexp_replace(c, r"\(cid:\d+\)", "")
    c = F.regexp_replace(c, "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f]", "")
    c = F.regexp_replace(F.translate(c, " ", " "), r"\s+,", ",")
    return squeeze(c)


def words(c: Column) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Non-empty stripped lines, in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip), lambda x: x != "")


def is_malformed(line: Column) -> Column:
    """A long unbroken line, or one in which more than 12 % of the characters are odd."""
    odd = F.length(F.regexp_replace(line, r"(?U)[\p{L}\p{N}\s.,:/&()\-+%#@]", ""))
    return (F.length(line) >= 30) & ~F.contains(line, F.lit(" ")) | line.rlike(r"\p{L}") & (odd / F.length(line) > 0.12)


def dice(a: Column, b: Column) -> Column:
    """Dice overlap of two arrays taken as sets; 1 for two empty ones."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def tokens(c: Column) -> Column:
    """Lower-case letter and digit runs."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def grade(score: Column, ladder: tuple[tuple[float, str], ...] = ((85, "A"), (70, "B"), (55, "C"), (40, "D")), least: str = "F") -> Column:
    out = F.lit(least)
    for bound, name in reversed(ladder):
        out = F.when(score >= bound, name).otherwise(out)
    return out
