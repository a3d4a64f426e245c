"""Contact data: finding it and masking it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s\-()]{8,}\d"
URL = r"(?:https?://|www\.)[^\s<>()]+"
#: Link labels by domain, in order of precedence.
DOMAINS = (
    ("linkedin.com", "LinkedIn"), ("github.com", "GitHub"), ("gitlab.com", "GitLab"), ("kaggle.com", "Kaggle"), ("leetcode.com", "LeetCode"),
    ("medium.com", "Medium"), ("behance.net", "Behance"), ("dribbble.com", "Dribbble"), ("stackoverflow.com", "Stack Overflow"),
)
CONNECTORS = ("de", "van", "von", "der", "la", "al", "bin", "del", "da", "di")


def email(text: Column) -> Column:
    """The first address, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(text, EMAIL, 0)), F.lit(""))


def phone(text: Column) -> Column:
    """The first number of ten digits or more outside addresses and links; Indian mobile numbers in their usual form."""
    rest = F.regexp_replace(text, f"{EMAIL}|{URL}", " ")
    found = F.regexp_extract(rest, PHONE, 0)
    digits = F.regexp_replace(found, r"\D", "")
    return F.when(F.length(digits) < 10, None).when((F.length(digits) == 10) & digits.rlike("^[6-9]"), F.concat(F.lit("+91 "), F.substring(digits, 1, 5), F.lit(" "), F.substring(digits, 6, 5))).otherwise(F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit("")))


def looks_like_name(text: Column) -> Column:
    """Two to four capitalised words (connectors may be small), 4 to 55 characters, no digits, addresses or links."""
    t = F.trim(text)
    parts = F.split(t, r"\s+")
    word = lambda w: w.isin(*CONNECTORS) | w.rlike(r"^\p{Lu}[\p{L}'’.-]*$")
    return F.length(t).between(4, 55) & ~t.rlike(r"[\d@/\\|:;]") & F.size(parts).between(2, 4) & F.forall(parts, word)


def link_label(url: Column) -> Column:
    out = F.lit("Portfolio")
    for domain, label in reversed(DOMAINS):
        out = F.when(F.contains(F.lower(url), F.lit(domain)), label).otherwise(out)
    return out


def mask_email(c: Column, how: str) -> Column:
    user, host = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    return {
        "mask": F.concat(F.substring(user, 1, 1), F.lit("***@"), host),
        "redact": F.lit("[EMAIL REDACTED]"),
        "pseudonym": F.concat(F.lit("user_"), F.substring(F.md5(c.cast("binary")), 1, 6), F.lit("@example.com")),
        "partial": F.concat(F.substring(user, 1, 2), F.repeat(F.lit("*"), F.greatest(F.length(user) - 2, F.lit(0))), F.lit("@"), host),
    }[how]


def mask_phone(c: Column, how: str) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return {
        "mask": F.concat(F.lit("******"), F.substring(digits, F.length(digits) - 3, F.lit(4))),
        "redact": F.lit("[PHONE REDACTED]"),
        "pseudonym": F.lit("+00 00000 00000"),
        "partial": F.concat(F.substring(digits, 1, 2), F.repeat(F.lit("*"), F.greatest(F.length(digits) - 4, F.lit(0))), F.substring(digits, F.length(digits) - 1, F.lit(2))),
    }[how]


def mask_name(c: Column, how: str) -> Column:
    return {
        "mask": F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.substring(w, 1, 1), F.lit("***"))), " "),
        "redact": F.lit("[NAME REDACTED]"),
        "pseudonym": F.concat(F.lit("Candidate "), F.upper(F.substring(F.md5(c.cast("binary")), 1, 6))),
        "partial": F.concat(F.substring_index(c, " ", 1), F.lit(" "), F.substring(F.substring_index(c, " ", -1), 1, 1), F.lit(".")),
    }[how]
