"""Repairs across sections: entries that look like another section's go, an evidenced section that is left empty is
recovered from what the strategies read, checks name the places that a repair takes out.

An entry's own lines are counted as a block by itself, in its row: no shuffle for that. Distinct entries are told by a
window over a document's entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import signatures
from .repairs import compare_form, tidy
from .skills import normalize_skills

#: Addresses that are degrees, words that are no skills.
DEGREE_HOSTS = ("b.tech", "m.tech", "b.sc", "m.sc", "bca", "mca", "be", "me", "mba", "bba")
ACTIONS = (
    "achieved architected automated built collaborated conceptualized created demonstrating designed developed engineered implemented improved increased integrated led maintained managed optimized participated researched resolved "
    "streamlined supported"
).split()
PASTIMES = "badminton cricket football music flute mridang guitar piano dance reading writing travelling".split()
FRAGMENTS = "deep machine demonstrating engineered conceptualized participated actively completed awarded".split()
PLATFORMS = ("linkedin", "github")

_text = lambda c: F.coalesce(F.col(c), F.lit(""))
_low = lambda c: F.lower(_text(c))


def distinct_items(items: Column) -> Column:
    """Tidied items in order, each once in any case."""
    tidied = F.filter(F.transform(items, tidy), lambda x: x.isNotNull())
    return F.aggregate(tidied, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def _signed(entries: DataFrame, lines: Column) -> DataFrame:
    said = F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != "")
    apart = entries.select(F.struct("*").alias("__entry"), said.alias("lines"))  # an entry may have columns named as counts are
    # as a generated row: a filter on scores would else be moved down with a copy of all that they are made of
    scores = F.explode(F.array(F.struct(*[f"{k}_score" for k in signatures.KINDS])))
    return signatures.section_scores(signatures.features(apart)).select("__entry", scores.alias("__s")).select("__entry.*", "__s.*")


def _first_of(entries: DataFrame, key: str, order: list, same: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key, *map(_low, same)).orderBy(*order))
    return entries.withColumn("__n", n).filter("__n = 1").drop("__n")


def _with_evidence(entries: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """entries with has_experience and has_projects: whether the document shows such a section."""
    shown = evidence.groupBy(key).agg(F.max(F.col("section") == "experience").alias("has_experience"), F.max(F.col("section") == "projects").alias("has_projects"))
    return entries.join(shown, key, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_experience", "has_projects")})


_EXPERIENCE, _PROJECT = ("company", "title", "location", "start", "end"), ("name", "description", "start", "end", "url")


def _clean_experience(x: DataFrame) -> DataFrame:
    return x.withColumns({c: tidy(F.col(c)) for c in _EXPERIENCE} | {"bullets": distinct_items(F.col("bullets"))})


def _clean_projects(x: DataFrame) -> DataFrame:
    x = x.withColumns({c: tidy(F.col(c)) for c in _PROJECT} | {"technologies": distinct_items(F.col("technologies"))})
    return x.withColumn("name", F.regexp_replace("name", r"^\d+[.)]\s*", ""))


def _experience_lines() -> Column:
    return F.concat(F.array("company", "title", "location"), F.col("bullets"))


def _project_lines() -> Column:
    return F.concat(F.array("name", "description"), F.col("technologies"))


def repair_experience(entries: DataFrame, evidence: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """entries (company, title, location, start, end, bullets) that are no education (from 0.55 on and above experience)
    and, where the document shows no experience section, no projects (by more than 0.2); cleaned, each once."""
    x = _with_evidence(_signed(entries, _experience_lines()), evidence, key)
    e, p, d = F.col("experience_score"), F.col("projects_score"), F.col("education_score")
    said = (_text("company") != "") | (_text("title") != "") | (F.size("bullets") > 0)
    kept = x.filter(~((d > e) & (d >= 0.55)) & ~(~F.col("has_experience") & (p > e + 0.2)) & said)
    return _first_of(_clean_experience(kept.select(key, order, *_EXPERIENCE, "bullets")), key, [order], ["company", "title", "start"])


def repair_projects(entries: DataFrame, evidence: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """entries (name, description, start, end, url, technologies) with a name that are no education (from 0.6 on and above
    projects) and, in documents that show experience but no projects, no experience (by more than 0.15)."""
    x = _with_evidence(_signed(entries, _project_lines()), evidence, key)
    e, p, d = F.col("experience_score"), F.col("projects_score"), F.col("education_score")
    kept = x.filter(~((d >= 0.6) & (d > p)) & ~(F.col("has_experience") & ~F.col("has_projects") & (e > p + 0.15)) & (_text("name") != ""))
    return _first_of(_clean_projects(kept.select(key, order, *_PROJECT, "technologies")), key, [order], ["name", "start"])


def recover(kept: DataFrame, read: DataFrame, evidence: DataFrame, section: str, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """kept, and for documents that show the section but keep no entry, what the strategies read (ord, order) with a
    signature of 0.45 or more, in that order, cleaned, each once. Recovered rows have recovered = true and new places."""
    experience = section == "experience"
    columns = [*(_EXPERIENCE if experience else _PROJECT), "bullets" if experience else "technologies"]
    empty = evidence.filter(F.col("section") == section).select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")
    x = _signed(read.join(empty, key, "left_semi"), _experience_lines() if experience else _project_lines()).filter(F.col(f"{section}_score") >= 0.45).select(key, "ord", order, *columns)
    x = _first_of(_clean_experience(x) if experience else _clean_projects(x), key, ["ord", order], ["company", "title", "start"] if experience else ["name", "start"])
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord", order)).cast("long")
    return kept.select(key, order, *columns, F.lit(False).alias("recovered")).unionByName(x.select(key, place.alias(order), *columns, F.lit(True).alias("recovered")))


def repair_links(links: DataFrame, key: str = "doc_id", order: str = "pos") -> DataFrame:
    """key, order, label, url: http addresses with a dotted host, none that is a degree taken for a portfolio; each once,
    whatever its case and closing slash. A link without a label is a "Link"."""
    x = links.select(key, order, F.coalesce(tidy(F.col("label")), F.lit("Link")).alias("label"), tidy(F.col("url")).alias("url"))
    host = F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#]*)", 1))
    ok = F.col("url").rlike("(?i)^https?://") & F.contains(host, F.lit(".")) & ~((F.lower("label") == "portfolio") & host.isin(*DEGREE_HOSTS))
    same = F.lower(F.regexp_replace("url", "/+$", ""))
    return x.filter(ok).withColumn("__n", F.row_number().over(Window.partitionBy(key, same).orderBy(order))).filter("__n = 1").drop("__n")


def bare_skill(c: Column) -> Column:
    """Folded, without edges; a closing acronym in brackets goes if it is made of the words' first letters."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), "^[ ,]+|[ ,]+$", "")
    closing = r"\(([A-Z]{2,6})s?\)\s*$"
    name = F.trim(F.regexp_replace(t, closing, ""))
    initials = F.array_join(F.transform(F.regexp_extract_all(name, F.lit("([A-Za-z]+)")), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(t.rlike(closing) & (name != "") & (initials == F.regexp_extract(t, closing, 1)), name).otherwise(t)


def repair_checked_skills(skills: DataFrame, checks: DataFrame, pastimes: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, order, skill: canonical names of skills, each once, without those that a check names.

    checks (key, path) are grey or invalid findings; "skills[3]" takes out the fourth skill of a person. Actions,
    pastimes, fragments and platforms are no skills; neither are names of no known category that are short capitals, a
    single word in lower case, more than four words, or said among a person's pastimes (key, text).
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long") - 1
    index = F.regexp_extract("path", r"^skills\[(\d+)\]", 1).try_cast("long")
    named = checks.select(key, index.alias("place")).filter("place IS NOT NULL").distinct()
    x = skills.withColumn("place", place).join(named, [key, "place"], "left_anti").withColumn("raw", bare_skill(F.col("skill"))).filter("raw <> ''")
    told = pastimes.groupBy(key).agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), " ")).alias("told"))
    y = normalize_skills(x.select(key, order, "raw")).join(told, key, "left")
    raw, low, other = F.col("raw"), F.lower("raw"), F.col("category") == "Other"
    n = F.size(F.split("raw", " "))
    odd = other & (raw.rlike("^[A-Z]{2,5}$") | (n == 1) & ~raw.rlike("^[A-Z0-9+#./-]{2,12}$") | (n > 4) | F.coalesce(F.contains("told", low), F.lit(False)))
    kept = y.filter(~low.isin(*ACTIONS, *PASTIMES, *FRAGMENTS, *PLATFORMS) & ~low.startswith("machine (") & ~low.startswith("deep (") & ~odd)
    first = F.row_number().over(Window.partitionBy(key, F.lower(F.trim("canonical"))).orderBy(order))
    return kept.withColumn("n", first).filter("n = 1").select(key, order, F.trim("canonical").alias("skill"))


def spaced_items(items: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, items: pastimes with one space behind each comma, none that hold or are held by one kept before them."""
    folded = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("item", F.lit("")), r"\s+", " ")), "^[ ,]+|[ ,]+$", "")
    parts = F.filter(F.transform(F.split(folded, ","), lambda p: F.trim(p)), lambda p: p != "")
    text = F.when(F.contains(folded, F.lit(",")), F.array_join(parts, ", ")).otherwise(folded)
    rows = items.select(key, F.struct(F.col(order).alias("o"), text.alias("t"), compare_form(text).alias("n")).alias("s")).filter("s.t <> ''")
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("all"))  # one person's list
    known = lambda a, x: F.exists(a, lambda k: F.contains(k["n"], x["n"]) | F.contains(x["n"], k["n"]))
    kept = F.aggregate("all", F.array().cast(per.schema["all"].dataType), lambda a, x: F.when(known(a, x), a).otherwise(F.array_append(a, x)))
    return per.select(key, F.array_join(F.transform(kept, lambda s: s["t"]), "; ").alias("items"))
