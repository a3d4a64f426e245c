"""Skills sections to skills: lines are cut by the first rule that fits, items cleaned, and those that are no skills left
out. Every item is a row, so a section of any length is spread like any other table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sections

#: Labels inside and before lists of skills.
EMBEDDED_LABEL = r"(?i)\s+(?=(?:AI/ML|Backend/Tools|Backend|Big\s+Data|Core\s+CS|Databases?|Database\s*&\s*Cloud|Developer\s+Tools?|Frameworks(?:/Tools|\s*&\s*Tools)?|Languages?|Libraries\s*&\s*Technologies|Tools?)\s*:)"
LABEL_BEFORE = (
    r"(?i)^(?:languages?|programming\s+languages?|development|design|databases?|developer\s+tools?|business\s+intelligence\s+tools?|ai/ml|ai\s*&\s*ml|iot\s+platforms?|frameworks?|libraries|tools?|cloud|platforms?|"
    r"technologies|technical\s+skills?|core\s+skills?|key\s+skills?)\s*:\s*"
)
LEVEL_BEFORE = r"(?i)^(?:Frontend|Backend|Others?|Skills?|Advanced|Intermediate|Basic|Expert|Proficient|Familiar|Beginner|Working\s+Knowledge|Primary|Secondary)[:\s]+"
SIGNS = "•·◦►▸●▶✓✔"
#: What is cleaned off an item, in this order.
CLEANED = (
    (r"(?i)\s*\((?:Less\s+Than\s+)?\d+\+?\s+Years?\)\s*", " "),
    (r"(?i)\s*[-–,]?\s*(?:Less\s+Than\s+)?\d+\+?\s+Years?$", ""),
    (r"(?i)(?:Backend/Tools|Big\s+Data|Core\s+CS|Databases|Developer\s+Tools|Frameworks(?:/Tools|\s*&\s*Tools)?|Libraries\s*&\s*Technologies|Languages?)\s*:?$", ""),
    (r"(?i)\s*\((?:Basic|Intermediate|Advanced|Beginner|Expert|Proficient|Familiar|Working\s+Knowledge|Strong|Moderate)\)\s*", ""),
    (r"(?i)\s*[-–:]\s*(?:Basic|Intermediate|Advanced|Beginner|Expert|Proficient)\s*$", ""),
    (r"(?i)\s*\((?:Certified|Certification|Certificate|Global\s+Certification|Preparing\s+For|Currently\s+Preparing|Basic\s+Knowledge|[^)]{0,40}(?:Associate|Developer|Practitioner|Professional|Expert|Foundation)[^)]{0,40})\)\s*$", ""),
)
#: Words that are no technical skills, openings and patterns of what is none.
SOFT = (
    "communication; teamwork; leadership; time management; problem solving; critical thinking; self-motivated; self motivated; quick learner; detail-oriented; detail oriented; adaptable; interpersonal; organizational; multitasking; "
    "collaborative; proactive; result-oriented; result oriented; deadline-driven; fast learner; team player; hardworking; dedicated; passionate; motivated; creative; innovative; analytical; strategic; dynamic; bilingual; multilingual; "
    "ability to; ability to work; willingness to"
).split("; ")
OPENINGS = ("ability to", "willingness to", "fluent in", "knowledge of", "experience with", "experience in")
CONTACTS = (r"[A-Za-z0-9][A-Za-z0-9_.+\-]*@[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", r"\+?\d[\d\s\-()]{8,}\d", r"(?i)(?:https?://)?(?:www\.)?(?:linkedin\.com/[^\s]+|github\.com/[^\s]+)")
NO_SKILL = (
    r"\b(?:university|college|school|academy|class x(?!ii)|class xii|secondary school|b\.?tech\s+in|cgpa|dehradun|present\b|202[0-9]\b)\b",
    r"^gpa\s*[:=]|^cgpa\s*[:=]|^grade\s*[:=]|^marks\s*[:=]",
    r"^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{4}$",
    r"^\d{4}\s*[-–]\s*(?:\d{4}|present)$",
    r"\b(?:bachelor|master|b\.tech|m\.tech|b\.sc|m\.sc|b\.e|m\.e|bca|mca|mba)\s+(?:in|of)\b",
    r"\b(?:scholastic|co-scholastic|achievement|distinction|extracurricular|accomplishment)\b",
)


def line_items(line: Column) -> Column:
    """The items of a line: its own lines; else cells apart by tabs or wide gaps; else between signs or bars; else between
    commas; else all of it. Labels inside a line part it, labels before it go."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, EMBEDDED_LABEL, " | "), LABEL_BEFORE, ""), LEVEL_BEFORE, "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    filled = lambda items: F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    cells = filled(F.split(text, r"\t+|   +"))
    wide = (F.contains(text, F.lit("\t")) | (F.size(F.split(text, "   +")) > 2)) & (F.size(cells) >= 2) & F.forall(cells, lambda c: F.length(c) <= 40)
    return (
        F.when(F.contains(line, F.lit("\n")), filled(F.split(line, "\n"))).when(text == "", F.array().cast("array<string>")).when(wide, cells)
        .when(text.rlike(f"[|{SIGNS}]"), filled(F.split(text, f"[|{SIGNS}]"))).when(F.contains(text, F.lit(",")), filled(F.split(text, ","))).otherwise(F.array(text))
    )


def clean_item(item: Column) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(item, r"\s+", " ")), "^[•\\-–—*·◦►▸]+|[•\\-–—*·◦►▸]+$", "")
    for pattern, instead in CLEANED:
        t = F.regexp_replace(t, pattern, instead)
        if instead == "" and "Years" not in pattern:
            t = F.trim(t)
    return F.trim(t)


def section_skills(lines: DataFrame, spark_headings: DataFrame, fuzzy_headings: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, rank (from 1), skill: the skills of a section in order, each once in any case."""
    x = lines.select(key, order, F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).filter("line <> ''")
    x = x.select(key, order, F.posexplode(line_items(F.col("line"))).alias("no", "item")).withColumn("line", clean_item(F.col("item"))).withColumn("low", F.lower("line"))
    low, skill = F.col("low"), F.col("line")
    none = low.isin(*SOFT) | skill.rlike(r"^\d+$")
    for opening in OPENINGS:
        none |= low.startswith(opening)
    for pattern in CONTACTS:
        none |= skill.rlike(pattern)
    for pattern in NO_SKILL:
        none |= low.rlike(pattern)
    shouted = F.size(F.filter(F.split(skill, " "), lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    none |= F.contains(skill, F.lit("/")) & (F.size(F.split(skill, " ")) >= 3) & (shouted >= 2)
    x = sections.match_fuzzy(sections.match_headings(x.filter(F.length("line").between(1, 60) & ~none), spark_headings, key), fuzzy_headings).filter("section IS NULL AND fuzzy_section IS NULL")
    first = F.row_number().over(Window.partitionBy(key, "low").orderBy(order, "no"))
    one = x.withColumn("__n", first).filter("__n = 1")
    return one.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order, "no")).alias("rank"), F.col("line").alias("skill"))
