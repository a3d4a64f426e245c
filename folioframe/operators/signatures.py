"""What a block of lines looks like: counts of its forms and words, and how much it is like each kind of section.

A block's words are split once and met with each list of words as arrays; only words with signs inside them, and
phrases, are searched in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_listed = lambda s: tuple(w.strip() for w in s.split(", "))
#: Words and phrases that speak for a kind of section; each counts once.
KEYWORDS = {
    "tech": _listed(
        "python, java, javascript, typescript, c++, c#, c, go, golang, rust, swift, kotlin, scala, r, matlab, perl, ruby, php, html, css, sql, nosql, bash, shell, powershell, react, angular, vue, node, nodejs, express, django, flask, "
        "spring, fastapi, nestjs, nextjs, gatsby, svelte, tensorflow, pytorch, keras, scikit, pandas, numpy, scipy, matplotlib, seaborn, plotly, tableau, powerbi, excel, docker, kubernetes, aws, gcp, azure, heroku, vercel, "
        "git, github, gitlab, bitbucket, jenkins, travis, circle, mysql, postgresql, postgres, mongodb, redis, sqlite, elasticsearch, kafka, rabbitmq, graphql, rest, api, linux, ubuntu, windows, macos, android, ios, "
        "machine learning, deep learning, nlp, ai, ml, data science, opencv, langchain, llm, transformer, bert, gpt, agile, scrum, jira, confluence, html5, css3, sass, less, webpack, vite, firebase, supabase, prisma, sequelize, "
        "spark, hadoop, hive, airflow, dbt, figma, sketch, adobe xd, photoshop, illustrator, postman, swagger, openapi"
    ),
    "role": _listed(
        "intern, internship, engineer, developer, analyst, manager, senior, junior, associate, lead, architect, consultant, specialist, coordinator, director, officer, head, executive, president, vp, cto, ceo, founder, co-founder, "
        "researcher, scientist, professor, assistant, teaching, part-time, full-time, contract, freelance, remote, trainee, apprentice, fellow, staff"
    ),
    "org": _listed("technologies, solutions, systems, services, labs, ltd, limited, inc, corporation, corp, company, enterprises, group, global, international, india, pvt, private, software, tech, digital, consulting, research"),
    "school": _listed(
        "university, college, institute, school, iit, nit, bits, faculty, department, campus, academy, polytechnic, bachelor, master, phd, doctorate, diploma, degree, b.tech, m.tech, btech, mtech, bca, mca, b.sc, m.sc, bsc, msc, bba, mba, "
        "engineering, science, arts, gpa, cgpa, percentage, grade, marks, distinction, honours, honors, merit, scholarship, 10th, 12th, ssc, hsc, cbse, icse, ict"
    ),
    "project": _listed(
        "built, developed, created, implemented, designed, deployed, launched, architected, engineered, automated, integrated, app, application, system, platform, tool, library, framework, bot, chatbot, api, website, portal, "
        "dashboard, model, algorithm, pipeline, service, github, open source, repo, repository"
    ),
    "award": _listed(
        "award, prize, honor, honour, scholarship, fellowship, merit, distinction, achievement, recognition, rank, winner, finalist, selected, recipient, granted, best, top, first, second, third, gold, silver, bronze, "
        "national, state, district, competition, hackathon, olympiad, contest, tournament"
    ),
}
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: Forms of lines, counted by line.
FORMS = {
    "bullets": r"^[•\-–—►▸●▶✓✔*]\s+",
    "ranges": rf"(?i){_MONTH}[a-z]*\.?\s*\d{{4}}\s*[-–—]\s*{_MONTH}[a-z]*\.?\s*\d{{4}}|{_MONTH}[a-z]*\.?\s*\d{{4}}\s*[-–—]\s*(?:Present|Current|Now|ongoing)|\b\d{{4}}\s*[-–—]\s*(?:\d{{4}}|Present|Current)\b",
    "dates": rf"(?i)\b{_MONTH}[a-z]*\.?\s+\d{{4}}\b|\b\d{{4}}\b",
    "degrees": (
        r"(?i)\b(?:B\.?(?:Sc|Tech|E|S|A|Com|Ed)|M\.?(?:Sc|Tech|E|S|A|Com|Ed|B|Phil)|Ph\.?D|B\.?B\.?A|M\.?B\.?A|B\.?C\.?A|M\.?C\.?A|Bachelor|Master|Doctor|Doctorate|Associate|Diploma|"
        r"B\.Eng|M\.Eng|BE|ME|BTech|MTech|BCA|MCA|BSc|MSc|BBA|MBA|High\s+School|Secondary|Intermediate|10th|12th|SSC|HSC|CBSE|ICSE)\b"
    ),
    "grades": r"(?i)\b(?:GPA|CGPA|Percentage|Score|Grade)\s*[:\-]?\s*[\d.]+",
    "emails": r"[A-Za-z0-9_.+\-]+@[A-Za-z0-9\-]+\.[A-Za-z]{2,}",
    "phones": r"\+?\d[\d\s\-()]{8,}\d",
    "urls": r"(?i)https?://\S+|(?:www|linkedin|github)\.\S+",
}
#: Kinds of sections, the first of equal scores counts.
KINDS = ("skills", "experience", "education", "projects", "awards", "summary", "interests")


def phrase(word: str) -> str:
    """A pattern for a word with signs, between word boundaries as they are (a sign needs a letter behind it)."""
    return r"\b" + "".join(c if c.isalnum() or c == " " else rf"\{c}" for c in word) + r"\b"


def features(blocks: DataFrame, column: str = "lines") -> DataFrame:
    """blocks with the counts of each block's lines (an array of strings); the array goes."""
    ls = F.transform(F.col(column), T.strip)
    x = blocks.withColumn("__ls", ls).withColumn("__text", F.lower(F.array_join(column, " "))).drop(column)
    x = x.withColumn("__words", F.array_distinct(F.split("__text", r"\W+")))
    lines, text, words = F.col("__ls"), F.col("__text"), F.col("__words")
    count = lambda f: F.size(F.filter(lines, f))
    formed = lambda p: count(lambda v: v.rlike(p))
    of_form = {name: formed(p) for name, p in FORMS.items()}
    of_words = {}
    for kind, listed in KEYWORDS.items():
        plain, signed = [w for w in listed if w.isalnum()], [w for w in listed if not w.isalnum()]
        of_words[kind] = F.size(F.array_intersect(words, F.array(*map(F.lit, plain)))) + sum((text.rlike(phrase(w)).cast("int") for w in signed), F.lit(0))
    n = F.size(lines)
    total = F.aggregate(lines, F.lit(0), lambda a, v: a + F.length(v))
    sized = {
        "line_count": n, "avg_len": F.when(n > 0, total / n).otherwise(0.0), "short_lines": count(lambda v: F.size(T.words(v)) <= 4), "long_lines": count(lambda v: F.size(T.words(v)) > 20),
        "has_contact": F.exists(lines, lambda v: v.rlike(FORMS["emails"]) | v.rlike(FORMS["phones"])),
    }
    return x.withColumns(sized | of_form | of_words).drop("__ls", "__text", "__words")


def block_features(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key and the counts of all lines of each block; key may be a struct."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "line"))), lambda v: v["line"])
    return features(lines.groupBy(key).agg(ordered.alias("lines")))


def section_scores(counted: DataFrame) -> DataFrame:
    """counted with a score of each kind of section, the best section, and its score; none under 0.25.

    Terms are added one after the other, so that sums that stand at a bound come out alike everywhere.
    """
    f = F.col
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    part = lambda c, by, top: F.least(f(c) / float(by), F.lit(top))
    no_bullet, no_range, avg = f("bullets") == 0, f("ranges") == 0, f("avg_len")
    long = F.when(avg > 80, 0.55).when(avg > 55, 0.45).when(avg > 40, 0.30).when(f("long_lines") >= 1, 0.20).otherwise(0.0)
    terms = {
        "skills": (on(f("tech") >= 2, 0.4 + part("tech", 20, 0.4)), on(no_bullet & no_range & (f("tech") >= 3), 0.15), on((avg < 80) & no_bullet & (f("tech") >= 2), 0.1)),
        "experience": (on(f("ranges") >= 1, 0.3), on(f("role") >= 1, 0.2 + part("role", 5, 0.2)), on(f("org") >= 1, 0.15), on(f("bullets") >= 2, 0.2), on((f("ranges") >= 1) & (f("bullets") >= 1), 0.15)),
        "education": (on(f("degrees") >= 1, 0.5), on(f("grades") >= 1, 0.2), on(f("school") >= 2, 0.2 + part("school", 8, 0.2)), on((f("degrees") >= 1) & (f("dates") >= 1), 0.1)),
        "projects": (on(f("project") >= 2, 0.3 + part("project", 8, 0.3)), on((f("tech") >= 1) & (f("bullets") >= 1) & no_range, 0.2), on((f("urls") >= 1) & (f("bullets") >= 1), 0.15)),
        "awards": (on(f("award") >= 1, 0.3 + part("award", 5, 0.3)), on((f("bullets") >= 1) & (f("award") >= 1), 0.15)),
        "summary": (on(no_bullet & no_range, long), on((f("line_count") <= 4) & (avg > 50) & no_range & no_bullet, 0.15)),
        "interests": (on((avg < 40) & (f("bullets") >= 1) & no_range, 0.2), on((f("bullets") >= 2) & (f("tech") == 0) & no_range, 0.1)),
    }
    out = counted.withColumns({f"{k}_score": F.when(f("line_count") > 0, F.least(sum(ts[1:], ts[0]), F.lit(1.0))).otherwise(0.0) for k, ts in terms.items()})
    best = F.array_max(F.array(*[F.struct(F.col(f"{k}_score").alias("score"), F.lit(-i).alias("ord"), F.lit(k).alias("name")) for i, k in enumerate(KINDS)]))
    return out.withColumn("best_section", F.when(best["score"] >= 0.25, best["name"])).withColumn("best_score", best["score"])


def classify(lines: DataFrame, key: str = "doc_id", order: str = "line_no", least: float = 0.35) -> DataFrame:
    """key, section: what each block is, from a score of `least` on; or null."""
    return section_scores(block_features(lines, key, order)).select(key, F.when(F.col("best_score") >= least, F.col("best_section")).alias("section"))
