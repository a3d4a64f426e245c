"""Field checks, their summary score, and reports on profiles and bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts
from ..functions.text import grade, words
from . import likeness

#: Verbs that open strong bullets, phrases that open weak ones, what counts as a metric.
ACTION_VERBS = "achieved architected automated built created delivered designed developed drove engineered implemented improved increased launched led managed migrated optimized reduced scaled shipped".split()
WEAK_OPENINGS = ("responsible for", "worked on", "helped", "assisted", "involved in", "participated in", "duties included")
METRICS = (r"(?i)\d+(?:\.\d+)?\s*%", r"(?i)[$€£₹]\s*\d", r"(?i)\b\d+(?:\.\d+)?\s*(?:x|k|m|million|billion|users|customers|requests)\b", r"(?i)(?:from|reduced?|cut|decreased?)\s+\d+\s*(?:hours?|minutes?|days?|ms)\s+to\s+\d+")
#: Mail domains against which typing errors are looked for; weights of the sections' checks.
MAIL_DOMAINS = ("gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "protonmail.com", "proton.me", "live.com", "rediffmail.com")
SECTION_WEIGHTS = {"personal": 20, "skills": 20, "experience": 25, "education": 20, "links": 15}


def bullet_report(bullets: DataFrame, text: str = "bullet") -> DataFrame:
    """bullets with action verb, metric, number, weak opening, words and score (0 to 1)."""
    t = F.regexp_replace(F.trim(F.col(text)), r"^[•\-–—►▸●▶✓✔* ]+", "")
    x = bullets.withColumn("__t", t).withColumn("word_count", F.size(words(t)).cast("bigint"))
    metric = F.lit(False)
    for m in METRICS:
        metric = metric | F.col("__t").rlike(m)
    weak = F.lit(False)
    for w in WEAK_OPENINGS:
        weak = weak | F.startswith(F.lower("__t"), F.lit(w))
    x = x.withColumn("has_action_verb", F.coalesce(F.lower(F.get(words(F.col("__t")), F.lit(0))).isin(*ACTION_VERBS), F.lit(False))).withColumn("has_metric", metric).withColumn("has_number", F.col("__t").rlike(r"\d")).withColumn("is_weak", weak)
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    n = F.col("word_count")
    score = on(F.col("has_action_verb"), 0.35) + F.when(F.col("has_metric"), 0.35).when(F.col("has_number"), 0.15).otherwise(0.0) + F.when(n.between(8, 30), 0.20).when(n.between(6, 7), 0.10).otherwise(0.0) - on(F.col("is_weak"), 0.20)
    return x.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 3)).drop("__t")


def ranked_bullets(scored: DataFrame, key: str, order: str) -> DataFrame:
    """Up to three best bullets (0.6 or more) and three of those under 0.4: the report's own limits."""
    by = Window.partitionBy(key).orderBy(F.desc("score"), order)
    x = scored.withColumn("r", F.row_number().over(by)).withColumn("low", F.col("score") < 0.4)
    x = x.withColumn("lr", F.row_number().over(Window.partitionBy(key, "low").orderBy(F.desc("score"), order)))
    return x.filter(((F.col("r") <= 3) & (F.col("score") >= 0.6)) | (F.col("low") & (F.col("lr") <= 3))).select(key, order, "score", F.when(F.col("low"), "weak").otherwise("top").alias("kind"))


def quality_report(p: DataFrame) -> DataFrame:
    """Profiles (has_* booleans, dated, two_column, bullet_score) with ATS, completeness and overall scores and grades."""
    pts = lambda c, v: F.when(F.col(c), v).otherwise(0)
    ats = pts("has_name", 15) + pts("has_email", 15) + pts("has_phone", 10) + pts("has_skills", 15) + F.when(F.col("has_experience"), F.when(F.col("dated"), 15).otherwise(8)).otherwise(0) + pts("has_education", 10) - pts("two_column", 10) + pts("has_linkedin", 10) + pts("has_summary", 10)
    complete = {"has_name": 10, "has_email": 10, "has_phone": 8, "has_location": 5, "has_headline": 5, "has_links": 7, "has_summary": 8, "has_skills": 12, "has_experience": 15, "has_education": 12, "has_projects": 8}
    x = p.withColumn("quality_ats", F.greatest(F.lit(0), F.least(ats, F.lit(100))).cast("double")).withColumn("completeness", F.round(sum((pts(c, w) for c, w in complete.items()), F.lit(0)) * 100.0 / sum(complete.values()), 1))
    x = x.withColumn("overall", F.round(F.round(F.col("quality_ats") * 0.35 + F.col("completeness") * 0.35 + F.col("bullet_score") * 0.30, 9), 1))
    return x.withColumn("ats_grade", grade(F.col("quality_ats"))).withColumn("overall_grade", grade(F.col("overall")))


def mail_suggestion(mails: DataFrame, column: str = "email") -> DataFrame:
    """mails with the known domain that is most like the address's own, where that is not known itself (see likeness)."""
    known = mails.sparkSession.createDataFrame([(d,) for d in MAIL_DOMAINS], "name string")
    x = mails.withColumn("__host", F.lower(F.substring_index(column, "@", -1)))
    near = likeness.nearest(x.filter(F.contains(column, F.lit("@"))).select(F.col("__host").alias("value")), known)
    return x.join(near.select(F.col("value").alias("__host"), F.col("nearest").alias("suggested_domain")), "__host", "left").drop("__host")


def link_checks(links: DataFrame, key: str = "doc_id") -> DataFrame:
    """links (key, pos, label, url) with status: empty, malformed, duplicate, mismatch (label against host) or valid."""
    url = F.trim(F.coalesce("url", F.lit("")))
    host = F.lower(F.regexp_extract(url, r"^(?:https?://)?(?:www\.)?([^/?#:\s]+)", 1))
    same = F.row_number().over(Window.partitionBy(key, F.lower(url)).orderBy("pos"))
    label = contacts.link_label(host)
    known = F.col("label").isin(*[n for _, n in contacts.DOMAINS])
    status = F.when(url == "", "empty").when(~host.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"), "malformed").when(F.col("__same") > 1, "duplicate").when(known & (label != F.col("label")), "mismatch").otherwise("valid")
    return links.withColumn("__same", same).withColumn("status", status).drop("__same")


def date_checks(ranges: DataFrame, start: str = "start_date", end: str = "end_date", current: str = "is_current", last_year: int = 2035) -> DataFrame:
    """ranges with status: missing, reversed, far_future or valid."""
    s, e = F.col(start), F.col(end)
    status = F.when(s.isNull() & e.isNull(), "missing").when(~F.col(current) & (e < s), "reversed").when((F.year(s) > last_year) | (F.year(e) > last_year), "far_future").otherwise("valid")
    return ranges.withColumn("status", status)


def validation_score(checks: DataFrame, key: str = "doc_id") -> DataFrame:
    """checks (key, section, bucket: valid, grey or invalid) summed to a score of 100 and a grade."""
    weight = F.create_map(*[F.lit(x) for kv in SECTION_WEIGHTS.items() for x in kv])
    g = checks.groupBy(key, "section").agg(F.count_if(F.col("bucket") == "valid").alias("v"), F.count_if(F.col("bucket") == "grey").alias("h"), F.count(F.lit(1)).alias("n"))
    part = F.bround((F.col("v") + 0.5 * F.col("h")) / F.col("n") * weight[F.col("section")], 0).cast("bigint")
    out = g.groupBy(key).agg(F.sum(part).alias("validation_ats"), F.sum("v").alias("valid"), F.sum("h").alias("grey"), F.sum(F.col("n") - F.col("v") - F.col("h")).alias("invalid"))
    return out.withColumn("grade", grade(F.col("validation_ats")))


def confidence(scores: DataFrame, ladder: tuple = ((0.85, "A"), (0.70, "B"), (0.50, "C"), (0.30, "D"))) -> DataFrame:
    """scores (field_conf, agreement, completeness) with overall 0.6 / 0.25 / 0.15 and its grade."""
    x = scores.withColumn("overall", F.round(F.col("field_conf") * 0.6 + F.col("agreement") * 0.25 + F.col("completeness") * 0.15, 4))
    return x.withColumn("grade", grade(F.col("overall"), ladder))


def skill_checks(skills: DataFrame, key: str = "cand_id") -> DataFrame:
    """skills (key, pos, raw) with status: empty, duplicate, noisy or valid."""
    t = F.trim(F.coalesce("raw", F.lit("")))
    same = F.row_number().over(Window.partitionBy(key, F.lower(t)).orderBy("pos"))
    noisy = (F.length(t) > 45) | t.rlike(r"[.!?]$") | t.rlike(r"^\d+$") | (F.size(F.split(t, ",")) > 2) | t.rlike(r"(?i)^(?:awarded|won|worked|responsible)\b")
    return skills.withColumn("__same", same).withColumn("status", F.when(t == "", "empty").when(F.col("__same") > 1, "duplicate").when(noisy, "noisy").otherwise("valid")).drop("__same")


def personal_checks(people: DataFrame) -> DataFrame:
    """people (name, email, phone, location) with a bucket for each."""
    bucket = lambda ok, weak: F.when(ok, "valid").when(weak, "grey").otherwise("invalid")
    digits = F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), r"\D", ""))
    return people.select(
        "*",
        bucket(~F.col("name").rlike(r"\d") & (F.size(words(F.col("name"))) >= 2), ~F.col("name").rlike(r"\d")).alias("name_check"),
        bucket(F.col("email").rlike(f"^{contacts.EMAIL}$"), F.contains("email", F.lit("@"))).alias("email_check"),
        bucket(digits.between(10, 15), digits.between(7, 9)).alias("phone_check"),
        bucket(F.size(words(F.col("location"))) >= 2, F.col("location") != "").alias("location_check"),
    )


def union_checks(*parts: tuple[DataFrame, str, str, Column]) -> DataFrame:
    """One long table key, section, bucket from (table, key column, section, bucket)."""
    out = None
    for df, key, section, bucket in parts:
        one = df.select(F.col(key).alias("doc_id"), F.lit(section).alias("section"), bucket.alias("bucket"))
        out = one if out is None else out.unionByName(one)
    return out
