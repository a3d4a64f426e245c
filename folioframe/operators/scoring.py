"""How good each strategy's reading of a document is, field by field, and one profile of the best fields.

Ten fields are scored by what their entries hold; fields whose section the document does not show count for little, or
for nothing if they are empty. Every kind of entry is added up by document and strategy before anything is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .sections import match_headings

#: Weights of the fields, in order; fields that need a section of their name; what is left of a field without.
WEIGHTS = {"personal_info": 2.0, "links": 1.0, "skills": 1.0, "experience": 2.0, "education": 2.0, "projects": 1.5, "awards": 0.8, "interests": 0.5, "languages": 0.3, "summary": 0.2}
SHOWN = ("experience", "education", "projects", "skills", "awards", "interests")
UNSHOWN_SCORE, UNSHOWN_WEIGHT = 0.25, 0.35
#: Forms of an address; merged personal data stands from this score on.
EMAIL = r"^[A-Za-z0-9_.+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9.\-]{2,}$"
LEAST_PERSONAL = 0.25
PERSONAL = ("name", "email", "phone", "location", "headline")

_has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
_on = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)


def is_sentence(c: Column) -> Column:
    return (F.size(words(c)) > 10) | c.endswith(".")


def is_name(c: Column) -> Column:
    return F.coalesce(F.size(words(c)).between(2, 5) & ~c.rlike("[0-9]"), F.lit(False))


def is_identity(c: Column, section: Column) -> Column:
    """Two to six words without digits and signs that are no heading."""
    return F.coalesce(F.size(words(c)).between(2, 6) & ~c.rlike(r"[0-9@|/\\#:+=]") & section.isNull(), F.lit(False))


def is_phone(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, "[^0-9]", "")) >= 10, F.lit(False))


def personal_score(name: Column, section: Column, email: Column, phone: Column, location: Column) -> Column:
    points = F.when(is_name(name), 30).when(is_identity(name, section), 15).otherwise(0)
    return (points + _on(email.rlike(EMAIL), 30) + _on(is_phone(phone), 20) + _on(F.contains(location, F.lit(",")), 20)) / 100.0


def _mean(rows: DataFrame, field: str, points: Column, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(points) / (F.count(F.lit(1)) * 100.0)).alias("score")).select(*keys, F.lit(field).alias("field"), "score")


def list_scores(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, score of skills, awards, interests and languages (field, value): how many, and how clean."""
    n, long = F.count(F.lit(1)), lambda k: F.count_if(F.length("value") > k)
    clean = F.count_if(_has("value") & (F.length("value") <= 40) & ~F.col("value").rlike("^[•\\-–]"))
    g = items.groupBy(*keys, "field").agg(n.alias("n"), clean.alias("clean"), long(8).alias("long8"), long(3).alias("long3"))
    skills = F.round(F.least(F.col("n"), F.lit(24)) / 24.0 * (F.col("clean") / F.col("n")), 3)
    by = F.when(F.col("field") == "skills", skills).when(F.col("field") == "awards", F.col("long8") / 4.0).when(F.col("field") == "interests", F.col("long3") / 3.0).otherwise(F.col("n") / 4.0)
    return g.select(*keys, "field", F.least(by, F.lit(1.0)).alias("score"))


def strategy_scores(people: DataFrame, links: DataFrame, items: DataFrame, jobs: DataFrame, degrees: DataFrame, works: DataFrame, dictionary: DataFrame, evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, a score of each field, the global score: of each strategy (ord) that has a row of people.

    people: name, email, phone, location, headline, summary; links: url; items: field, value; jobs: company, title, start,
    bullets; degrees: institution, degree, start, gpa; works: name, description, start, technology, url; evidence: the
    sections that a document shows. A field without entries scores 0 and has no data.
    """
    keys = [key, "ord"]
    named = match_headings(people.withColumn("line", F.col("name")), dictionary, key)
    personal = named.select(*keys, F.lit("personal_info").alias("field"), personal_score(F.col("name"), F.col("section"), F.col("email"), F.col("phone"), F.col("location")).alias("score"))
    summary = people.filter(_has("summary")).select(*keys, F.lit("summary").alias("field"), F.lit(1.0).alias("score"))
    linked = links.groupBy(*keys).agg(F.least(F.count_if(F.col("url").rlike("(?i)^https?://[^/?#]+")) / 2.0, F.lit(1.0)).alias("score")).select(*keys, F.lit("links").alias("field"), "score")
    job = _on(_has("company") & ~is_sentence(F.col("company")), 30) + _on(_has("title"), 25) + _on(_has("start"), 20) + _on(F.col("bullets") > 0, 25)
    degree = _on(_has("institution"), 35) + _on(_has("degree"), 25) + _on(_has("start"), 20) + _on(_has("gpa"), 20)
    work = _on(_has("name") & ~is_sentence(F.col("name")), 45) + _on(_has("description"), 40) + _on(_has("start"), 10) + _on(_has("technology") | _has("url"), 5)
    parts = [personal, summary, linked, list_scores(items, keys), _mean(jobs, "experience", job, keys), _mean(degrees, "education", degree, keys), _mean(works, "projects", work, keys)]
    by = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, F.col("score"))).alias(f) for f in WEIGHTS])
    shown = evidence.groupBy(key).agg(F.collect_set("section").alias("__shown"))
    x = people.select(*keys).join(by, keys, "left").join(shown, key, "left").withColumn("__shown", F.coalesce("__shown", F.array().cast("array<string>")))
    score, weight = {}, {}
    for f, w in WEIGHTS.items():
        own = F.coalesce(F.col(f), F.lit(0.0))
        unshown = ~F.array_contains("__shown", f) if f in SHOWN else F.lit(False)
        score[f] = F.when(unshown & F.col(f).isNotNull(), F.least(own, F.lit(UNSHOWN_SCORE))).otherwise(own)
        weight[f] = F.when(unshown, F.when(F.col(f).isNotNull(), w * UNSHOWN_WEIGHT).otherwise(0.0)).otherwise(w)
    total = reduce(lambda a, b: a + b, weight.values())
    return x.select(*keys, *[s.alias(f"{f}_score") for f, s in score.items()], F.round(reduce(lambda a, b: a + b, [score[f] * weight[f] for f in WEIGHTS]) / total, 9).alias("global_score"))


def merge_profiles(people: DataFrame, scored: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the personal data, and for each other field the strategy (ord) it is taken from.

    Strategies are ranked by global score, then by ord. Each personal value is the first valid one in that order; if
    together they score too little, all are those of the strategy with the best personal data. Of equal field scores the
    first in rank counts.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("global_score"), "ord"))
    x = match_headings(people.join(scored, [key, "ord"]).withColumn("rank", rank).withColumn("line", F.col("name")), dictionary, key)
    valid = {
        "name": is_name(F.col("name")) | is_identity(F.col("name"), F.col("section")), "email": F.col("email").rlike(EMAIL), "phone": is_phone(F.col("phone")), "location": F.contains("location", F.lit(",")),
        "headline": F.length("headline") >= 4,
    }
    best = lambda f: F.struct(F.col(f"{f}_score"), -F.col("rank"))
    first = {c: F.min_by(c, F.when(F.coalesce(ok, F.lit(False)), F.col("rank"))) for c, ok in valid.items()}
    section = F.min_by("section", F.when(F.coalesce(valid["name"], F.lit(False)), F.col("rank")))
    g = x.groupBy(key).agg(
        F.struct(*[v.alias(c) for c, v in first.items()], section.alias("section")).alias("m"), F.max_by(F.struct(*PERSONAL), best("personal_info")).alias("p"), *[F.max_by("ord", best(f)).alias(f"{f}_from") for f in WEIGHTS if f != "personal_info"],
    )
    enough = personal_score(F.col("m.name"), F.col("m.section"), F.col("m.email"), F.col("m.phone"), F.col("m.location")) >= LEAST_PERSONAL
    return g.select(key, *[F.when(enough, F.col(f"m.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in PERSONAL], *[f"{f}_from" for f in WEIGHTS if f != "personal_info"])
