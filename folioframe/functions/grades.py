"""Grades on one scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Percent by four-point grade, four-point grade by percent, percent by letter and by class.
FOUR_TO_PERCENT = ((4.0, 97.0), (3.9, 95.0), (3.7, 92.0), (3.5, 88.5), (3.3, 86.0), (3.0, 83.0), (2.7, 78.0), (2.3, 75.0), (2.0, 73.0), (1.7, 68.0), (1.3, 64.0), (1.0, 61.0), (0.7, 56.0))
PERCENT_TO_FOUR = ((97, 4.0), (93, 3.9), (90, 3.7), (87, 3.3), (83, 3.0), (80, 2.7), (77, 2.3), (73, 2.0), (70, 1.7), (67, 1.3), (63, 1.0), (60, 0.7), (55, 0.5), (50, 0.3), (45, 0.1))
LETTERS = {"o": 96.0, "a+": 96.0, "a": 92.0, "a-": 87.5, "b+": 82.5, "b": 77.5, "b-": 72.5, "c+": 67.5, "c": 62.5, "c-": 57.5, "d+": 52.5, "d": 47.5, "d-": 42.5, "f": 25.0, "e": 25.0}
CLASSES = {
    "second class upper": 62.5, "second class lower": 52.5, "second class": 55.0, "distinction": 90.0, "first class": 72.5, "pass class": 45.0,
    "second": 55.0, "credit": 65.0, "first": 72.5, "merit": 75.0, "pass": 45.0, "fail": 25.0,
}
LABELS = "CGPA|GPA|Percentage|Score|Grade|Marks|Points|CPI|SPI|SGPA|DGPA"


def ladder(value: Column, steps, least: float) -> Column:
    out = F.lit(least)
    for bound, result in reversed(steps):
        out = F.when(value >= bound, F.lit(result)).otherwise(out)
    return out


def let(value: Column, use) -> Column:
    """use(value), where value stands in the plan once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_grade(raw: Column) -> Column:
    """struct(scale, percentage, gpa_4, cgpa_10): fractions, percents, letters and class words before bare numbers."""
    t = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), rf"(?i)\b(?:{LABELS})[:\s]*", ""))
    return let(t, lambda t: let(_read(t), _converted))


def _read(t: Column) -> Column:
    number = lambda p, k=1: F.regexp_extract(t, p, k).try_cast("double")
    fraction, percent = r"([\d.]+)\s*/\s*([\d.]+)", r"([\d.]+)\s*%"
    top, bottom = number(fraction, 1), number(fraction, 2)
    letter = F.lower(F.regexp_extract(t, r"(?i)^([A-FO][+-]?)$", 1))
    word = F.lower(F.regexp_extract(t, rf"(?i)\b({'|'.join(CLASSES)})\b", 1))
    by = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    bare = F.when(t.rlike(r"^[\d.]+$"), t.try_cast("double"))
    read = lambda scale, value: F.struct(F.lit(scale).alias("scale"), value.cast("double").alias("value"))
    return (
        F.when(bottom > 0, F.when(F.abs(bottom - 10) < 0.01, read("cgpa_10", top)).when((F.abs(bottom - 4) < 0.01) | (F.abs(bottom - 4.33) < 0.1), read("gpa_4", top)).when(F.abs(bottom - 100) < 0.5, read("percentage", top)).otherwise(read("percentage", top / bottom * 100)))
        .when(number(percent).isNotNull(), read("percentage", number(percent)))
        .when(by(LETTERS)[letter].isNotNull(), read("letter", by(LETTERS)[letter]))
        .when(by(CLASSES)[word].isNotNull(), read("class", by(CLASSES)[word]))
        .when(bare <= 4.33, read("gpa_4", bare)).when(bare <= 10, read("cgpa_10", bare)).when(bare <= 100, read("percentage", bare))
        .otherwise(read("unknown", F.lit(None)))
    )


def _converted(x: Column) -> Column:
    scale, value = x["scale"], x["value"]
    clamp = lambda high: F.greatest(F.lit(0.0), F.least(value, F.lit(high)))
    exact = F.when(scale == "cgpa_10", F.round(F.least(clamp(10.0) * 9.5, F.lit(100.0)), 1)).when(scale == "gpa_4", ladder(clamp(4.0), FOUR_TO_PERCENT, 50.0)).when(scale != "unknown", clamp(100.0))

    def result(percent: Column) -> Column:
        known = scale != "unknown"
        return F.struct(
            scale.alias("scale"),
            F.round(percent, 1).alias("percentage"),
            F.when(scale == "gpa_4", F.round(clamp(4.0), 2)).when(known, ladder(percent, PERCENT_TO_FOUR, 0.0)).alias("gpa_4"),
            F.when(scale == "cgpa_10", F.round(clamp(10.0), 2)).when(known, F.round(F.least(percent / 9.5, F.lit(10.0)), 2)).alias("cgpa_10"),
        )

    return let(exact, result)
