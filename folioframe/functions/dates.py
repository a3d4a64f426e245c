"""Dates as résumés write them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names, words for the present, range separators.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
PRESENT = r"(?:Present|Current|Now|Till\s*Date|To\s*Date|Ongoing|Till\s*Now|Running|Continuing|Today|Pursuing)"
TO = r"(?:\s*[-–—/]\s*|\s+to\s+|\s+till\s+|\s+through\s+|\s+until\s+)"
MY4, MY2, SLASH, YEAR = MONTH + r",?\s+\d{4}", MONTH + r"['’`]\d{2}", r"(?:0?[1-9]|1[0-2])/\d{4}", r"\b20\d{2}\b"

#: Forms of a range, the first that occurs anywhere in the text wins: (name, pattern with start and end).
RANGES = (
    ("months", rf"({MONTH})\s*[-–—]\s*({MONTH}),?\s+(\d{{4}})"),
    ("till", rf"({YEAR})\s+(?:till|until|upto|up\s*to)\s+(?:date|now|today|present)"),
    ("from", rf"\bfrom\s+({MY4}|{YEAR})\s+to\s+({MY4}|{PRESENT})"),
    ("since", rf"\bsince\s+({MY4}|{YEAR})"),
    ("month_year", rf"({MY4}){TO}({MY4}|{PRESENT})"),
    ("month_short", rf"({MY2}){TO}({MY2}|{PRESENT})"),
    ("slash", rf"({SLASH}){TO}({SLASH}|{PRESENT})"),
    ("years", rf"({YEAR}){TO}({YEAR}|{PRESENT})"),
    ("short_year", rf"({YEAR}){TO}(\b\d{{2}}\b)"),
    ("one_month_year", rf"({MY4})"),
    ("one_slash", rf"({SLASH})"),
    ("one_month_short", rf"({MY2})"),
    ("one_year", rf"({YEAR})"),
)


def _month_name(c: Column) -> Column:
    return F.initcap(F.lower(F.substring(c, 1, 3)))


def normalize_date(token: Column) -> Column:
    """"Mon YYYY" from full or short months, two-digit years (to 35: 20xx) and M/YYYY; years and the rest as they are."""
    t = F.regexp_replace(F.trim(token), "[.,]+$", "")
    long, short, slash = rf"(?i)^({MONTH}),?\s+(\d{{4}})", rf"(?i)^({MONTH})['’`](\d{{2}})", r"^(0?[1-9]|1[0-2])/(\d{4})"
    yy = F.regexp_extract(t, short, 2)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.coalesce(F.regexp_extract(t, slash, 1).try_cast("int"), F.lit(1)), F.lit(1)))
    return (
        F.when(t.rlike(long), F.concat_ws(" ", _month_name(F.regexp_extract(t, long, 1)), F.regexp_extract(t, long, 2)))
        .when(t.rlike(short), F.concat(_month_name(F.regexp_extract(t, short, 1)), F.when(yy.try_cast("int") <= 35, " 20").otherwise(" 19"), yy))
        .when(t.rlike(slash), F.concat_ws(" ", month, F.regexp_extract(t, slash, 2)))
        .otherwise(t)
    )


def date_range(text: Column) -> Column:
    """struct(form, start, end, is_current, remaining) of the first range or date in a text; form null if there is none.

    The winning form's groups are taken first and read once, so the expression stays small however many forms there are.
    """

    def found(name: str, pattern: str) -> Column:
        group = lambda k: F.regexp_extract(text, f"(?i){pattern}", k) if k <= re.compile(pattern).groups else F.lit("")
        return F.struct(F.lit(name).alias("form"), *[group(k).alias(f"g{k}") for k in (1, 2, 3)], F.split(text, f"(?i){pattern}", 2).alias("around"))

    def read(r: Column) -> Column:
        form = r["form"]
        months, alone = form == "months", form.startswith("one_")
        with_year = lambda month: F.when(months, F.concat_ws(" ", month, r["g3"])).otherwise(month)
        start = normalize_date(with_year(r["g1"]))
        current = F.when(form.isin("till", "since"), True).when(months | alone, False).otherwise(r["g2"].rlike(f"(?i)^{PRESENT}"))
        last = F.when(form == "short_year", F.concat(F.substring(F.regexp_extract(r["g1"], r"20\d{2}", 0), 1, 2), r["g2"])).otherwise(normalize_date(with_year(r["g2"])))
        joined = F.concat_ws(" ", F.regexp_replace(F.trim(r["around"][0]), "[,-]+$", ""), F.regexp_replace(F.trim(F.get(r["around"], F.lit(1))), "^[,-]+", ""))
        remaining = F.regexp_replace(F.trim(F.regexp_replace(joined, r"\s+", " ")), "[,-]+$", "")
        return F.struct(form.alias("form"), F.when(form.isNotNull(), start).alias("start"), F.when(~current & ~alone, last).alias("end"), F.when(form.isNotNull(), current).alias("is_current"), F.when(form.isNotNull(), remaining).otherwise(F.trim(text)).alias("remaining"))

    first = reduce(lambda out, r: F.when(text.rlike(f"(?i){r[1]}"), found(*r)).otherwise(out), reversed(RANGES), F.lit(None))
    return F.transform(F.array(first), read)[0]


def approximate_date(text: Column, year_month: int = 1) -> Column:
    """A date from "Mon YYYY" (an unknown month is January), "M/YYYY" or "YYYY" (first of year_month)."""
    name, slash = r"^([A-Za-z]{3})[a-z]*\.?\s+(\d{4})$", r"^(\d{1,2})/(\d{4})$"
    t = F.trim(text)
    at = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.regexp_extract(t, name, 1)))
    month = F.when(at > 0, at).otherwise(1).cast("int")
    number = F.regexp_extract(t, slash, 1).try_cast("int")
    return (
        F.when(t.rlike(name), F.make_date(F.regexp_extract(t, name, 2).try_cast("int"), month, F.lit(1)))
        .when(t.rlike(slash) & number.between(1, 12), F.make_date(F.regexp_extract(t, slash, 2).try_cast("int"), number, F.lit(1)))
        .when(t.rlike(r"^\d{4}$"), F.make_date(t.try_cast("int"), F.lit(year_month), F.lit(1)))
    )


def duration_years(start: Column, end: Column) -> Column:
    """Days between two dates over 365.25, never below 0; null if either is."""
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.datediff(end, start) / F.lit(365.25).cast("double"), F.lit(0.0)))
