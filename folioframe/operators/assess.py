"""How far the fields of a profile can be trusted, and checks of its entries.

Scores are added up in hundredths, which are exact, and divided once. Items come one a row, so a profile's lists may be
of any length; `evidence` has a row (key, section) for every section heading that the document shows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An address's form, a readable date, bullet signs, action verbs.
EMAIL = r"^[A-Za-z0-9][A-Za-z0-9_.+\-]*@[A-Za-z0-9][A-Za-z0-9\-]*\.[A-Za-z]{2,}(?:\.[A-Za-z]{2,})?$"
DATE = r"(?i)(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}|\b20\d{2}\b"
BULLET = r"^[•\-–—►▸●]"
VERBS = (
    "achieved architected automated built collaborated conducted created designed developed engineered evaluated executed implemented improved "
    "increased integrated launched led maintained managed optimized published reduced researched resolved scaled shipped streamlined supported "
    "tested trained transformed"
).split()
#: Points (hundredths) of what an entry has.
EXPERIENCE = (("company", 25), ("title", 25), ("start", 25))
EDUCATION = (("institution", 35), ("degree", 30), ("start", 20), ("gpa", 15))
PROJECT = (("name", 40), ("description", 35), ("start", 15), ("technology", 10))


def filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def points(test: Column, n: int | Column, other: int | Column = 0) -> Column:
    return F.when(test, n).otherwise(other)


def _shown(people: DataFrame, evidence: DataFrame, section: str, key: str) -> DataFrame:
    """people with `shown`: whether the document has that section's heading."""
    seen = evidence.filter(F.col("section") == section).select(key).distinct().withColumn("shown", F.lit(True))
    return people.select(key).join(seen, key, "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


def _scored(known: str, score: Column) -> Column:
    """score up to 1, 0 where `known` is null: least skips nulls, so a bound alone would stand for a missing score."""
    return F.when(F.col(known).isNotNull(), F.round(F.least(score, F.lit(1.0)), 3)).otherwise(0.0)


def personal_confidence(people: DataFrame, key: str = "cand_id") -> DataFrame:
    """key, score: name 2 to 5 words without digits .25 (else .10), e-mail .25 (.10), phone of ten digits .20 (.05),
    place .15, headline .15. Missing fields count nothing."""
    words = F.size(F.split(F.trim("name"), r"\s+"))
    name = points(filled("name"), points(words.between(2, 5) & ~F.col("name").rlike("[0-9]"), 25, 10))
    mail = points(filled("email"), points(F.col("email").rlike(EMAIL), 25, 10))
    phone = points(filled("phone"), points(F.length(F.regexp_replace("phone", "[^0-9]", "")) >= 10, 20, 5))
    total = name + mail + phone + points(filled("location"), 15) + points(filled("headline"), 15)
    return people.select(key, F.round(total / 100.0, 3).alias("score"))


def link_confidence(people: DataFrame, links: DataFrame, key: str = "cand_id") -> DataFrame:
    """key, score: a third for each valid web address up to .5, and .25 each for two well-known hosts; 0 without links."""
    valid = F.coalesce(F.col("url").rlike(r"^(?i)https?://[^/?#]+"), F.lit(False))
    low = F.lower("url")
    per = links.groupBy(key).agg(F.sum(valid.cast("int")).alias("n"), *[F.max(valid & F.contains(low, F.lit(h))).alias(c) for c, h in (("a", "linkedin.com"), ("b", "github.com"))])
    score = F.least(F.col("n") / 3.0, F.lit(0.5)) + points(F.col("a"), 25) / 100.0 + points(F.col("b"), 25) / 100.0
    return people.select(key).join(per, key, "left").select(key, _scored("n", score).alias("score"))


def skill_confidence(people: DataFrame, skills: DataFrame, evidence: DataFrame, key: str = "cand_id") -> DataFrame:
    """key, score: a twentieth of .4 a skill up to .4, the clean share of .4, and .2 for a skills heading; 0 without."""
    clean = filled("skill") & (F.length("skill") <= 50) & ~F.col("skill").rlike(BULLET)
    per = skills.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(clean.cast("int")).alias("ok"))
    score = F.least(F.col("n") / 20.0, F.lit(0.4)) + F.col("ok") / F.col("n") * 0.4 + points(F.col("shown"), 20) / 100.0
    return _shown(people, evidence, "skills", key).join(per, key, "left").select(key, _scored("n", score).alias("score"))


def entry_confidence(people: DataFrame, entries: DataFrame, evidence: DataFrame, section: str, key: str = "cand_id") -> DataFrame:
    """key, score of the experience, education or projects field: the mean of what the entries have (see the tables
    above; of experience also .05 for a readable start and .20 for bullets), and .10 or .05 for the section's heading.
    Without entries .1 if the heading is there, else 0."""
    parts = {"experience": EXPERIENCE, "education": EDUCATION, "projects": PROJECT}[section]
    each = reduce(lambda a, b: a + b, [points(filled(c), n) for c, n in parts])
    if section == "experience":
        each = each + points(filled("start") & F.col("start").rlike(DATE), 5) + points(F.col("bullets") > 0, 20)
    bonus = {"experience": 10, "education": 5, "projects": 0}[section]
    per = entries.groupBy(key).agg((F.sum(F.least(each, F.lit(100))) / (F.count(F.lit(1)) * 100.0)).alias("mean"))
    score = F.when(F.col("mean").isNotNull(), F.round(F.least(F.col("mean") + points(F.col("shown"), bonus) / 100.0, F.lit(1.0)), 3)).otherwise(points(F.col("shown"), 10) / 100.0)
    return _shown(people, evidence, section, key).join(per, key, "left").select(key, score.alias("score"))


def list_confidence(people: DataFrame, items: DataFrame, evidence: DataFrame, section: str, key: str = "cand_id") -> DataFrame:
    """key, score of awards, interests or languages: .8 of the share of items of over three letters, .2 for the heading; 0 without items."""
    per = items.groupBy(key).agg((F.sum(F.coalesce(F.length("item") > 3, F.lit(False)).cast("int")) / F.count(F.lit(1))).alias("share"))
    score = F.col("share") * 0.8 + points(F.col("shown"), 20) / 100.0
    return _shown(people, evidence, section, key).join(per, key, "left").select(key, _scored("share", score).alias("score"))


def like_sentence(c: Column) -> Column:
    """Ends in a full stop, or starts in lower case and has over four words."""
    t = F.trim(c)
    first = F.substring(t, 1, 1)
    return t.endswith(".") | ((first != F.upper(first)) & (F.size(F.split(t, r"\s+")) > 4))


def bullet_check(c: Column) -> Column:
    """valid for five words or more that start with an action verb, else grey."""
    words = F.split(F.trim(c), r"\s+")
    verb = F.regexp_replace(F.lower(F.get(words, F.lit(0))), r"^[.,;:()]+|[.,;:()]+$", "")
    return F.when((F.size(words) >= 5) & verb.isin(VERBS), "valid").otherwise("grey")


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b(?:19|20)\d{2}\b", 0), F.lit("")).cast("int")


def range_check(start: str = "start", end: str = "end_", current: str = "is_current") -> Column:
    """Status of a written date range; see the branches."""
    s, e = year_of(F.col(start)), F.when(~F.col(current), year_of(F.col(end)))
    return (
        F.when(~filled(start) & ~filled(end), "grey")
        .when(filled(start) & s.isNull(), "grey")
        .when(filled(end) & ~F.col(current) & e.isNull(), "grey")
        .when(e < s, "invalid")
        .when(s > 2035, "grey")
        .otherwise("valid")
    )


def entry_checks(entries: DataFrame, section: str, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, order, check, status of every experience, education or project entry."""
    there = lambda c, missing: F.when(filled(c), "valid").otherwise(missing)
    worded = lambda c, missing: F.when(~filled(c), missing).when(like_sentence(F.col(c)), "grey").otherwise("valid")
    checks = {
        "experience": lambda: {"company": worded("company", "invalid"), "title": worded("title", "grey"), "dates": range_check()},
        "education": lambda: {"institution": there("institution", "invalid"), "degree": there("degree", "grey"), "dates": range_check()},
        "projects": lambda: {
            "name": worded("name", "invalid"), "dates": range_check(), "url": F.when(F.coalesce(F.col("url"), F.lit("")).rlike(r"^(?i)https?://[^/?#]+"), "valid").otherwise("grey"),
            "description": F.when(filled("description"), bullet_check(F.col("description"))).otherwise("grey"), "technology": there("technology", "grey"),
        },
    }[section]()
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status")) for n, s in checks.items()]))
    return entries.select(key, order, rows.alias("c")).select(key, order, "c.check", "c.status")


def year_overlaps(entries: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, first, second: entries whose closed ranges of years meet. Both years must be readable."""
    spans = entries.select(key, F.col(order).alias("o"), year_of(F.col("start")).alias("s"), F.when(~F.col("is_current"), year_of(F.col("end_"))).alias("e")).filter("s IS NOT NULL AND e >= s")
    a, b = spans.alias("a"), spans.alias("b")
    meet = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.o") < F.col("b.o")) & (F.col("a.s") <= F.col("b.e")) & (F.col("b.s") <= F.col("a.e"))
    return a.join(b, meet).select(f"a.{key}", F.col("a.o").alias("first"), F.col("b.o").alias("second"))


def simple_list_checks(items: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, order, status: grey for empty, repeated and one-word items, else valid."""
    from pyspark.sql import Window

    t = F.trim(F.coalesce("item", F.lit("")))
    again = F.row_number().over(Window.partitionBy(key, F.lower(t)).orderBy(order)) > 1
    return items.select(key, order, F.when((t == "") | again | (F.size(F.split(t, r"\s+")) < 2), "grey").otherwise("valid").alias("status"))
