"""Entries of sections: summaries, experience bundles, projects, certifications, simple lists, technologies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import MY4, PRESENT, YEAR
from ..functions.text import squeeze, strip
from .skills import SKILLS

BULLET = r"^[\s]*[•▪●►▸\-–—*]+\s*"
HEADER = rf"(?i)\||\s+at\s+|{MY4}|{YEAR}\s*[-–—]\s*(?:{YEAR}|{PRESENT})"
#: The technologies of projects and their other names.
PROJECT_TECHNOLOGIES = {
    "Python": ("python", "py"), "React": ("react", "reactjs", "react.js"), "Node.js": ("node", "nodejs", "node.js"), "Streamlit": ("streamlit",), "LangChain": ("langchain", "lang chain"),
    "Large Language Models": ("llm", "llms", "large language model", "large language models"),
    "RAG (Retrieval-Augmented Generation)": ("rag", "retrieval augmented generation", "retrieval-augmented generation", "rag pipeline", "rag pipelines"),
    "Vector Databases": ("vector database", "vector databases"), "Natural Language Processing": ("nlp", "natural language processing"), "Pandas": ("pandas",), "scikit-learn": ("scikit-learn", "scikit learn", "sklearn"),
    "PyMuPDF": ("pymupdf", "py mupdf"), "Pillow": ("pillow",), "python-pptx": ("python-pptx",), "Arduino": ("arduino",), "Raspberry Pi": ("raspberry pi",), "ESP32": ("esp32", "esp 32"), "ESP8266": ("esp8266", "esp 8266"), "MQTT": ("mqtt",), "HTTP": ("http",),
}


def ordered(key: str, lines: DataFrame, order: str = "line_no", value: str = "line") -> DataFrame:
    """key, lines: a section's lines as one ordered array (a document's own lines, which are few)."""
    return lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("lines"))


def summary(lines: Column) -> Column:
    """Lines without bullets and an "objective:" opening, joined; null under 15 characters."""
    text = squeeze(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, BULLET, "")), " "))
    text = F.regexp_replace(text, r"(?i)^(?:objective|summary|profile|about me)\s*[:\-–]\s*", "")
    return F.when(F.length(text) >= 15, text)


def experience_bundles(lines: Column) -> Column:
    """array of struct(headers, bullets): bullets belong to the headers before them, a header after bullets opens the
    next bundle, and a plain line continues the last bullet."""
    entry = "struct<headers:array<string>,bullets:array<string>>"
    none = F.array().cast("array<string>")
    zero = F.struct(F.array().cast(f"array<{entry}>").alias("done"), none.alias("headers"), none.alias("bullets"))
    pack = lambda a: F.struct(a["headers"].alias("headers"), a["bullets"].alias("bullets"))

    def step(acc, line):
        bullet, header = line.rlike(BULLET), line.rlike(HEADER)
        text = strip(F.regexp_replace(line, BULLET, ""))
        has = F.size(acc["bullets"]) > 0
        opened = F.struct(F.array_append(acc["done"], pack(acc)).alias("done"), F.array(text).alias("headers"), none.alias("bullets"))
        added = F.struct(acc["done"].alias("done"), acc["headers"].alias("headers"), F.array_append(acc["bullets"], text).alias("bullets"))
        titled = F.struct(acc["done"].alias("done"), F.array_append(acc["headers"], text).alias("headers"), acc["bullets"].alias("bullets"))
        last = F.concat(F.element_at(acc["bullets"], -1), F.lit(" "), text)
        joined = F.struct(acc["done"].alias("done"), acc["headers"].alias("headers"), F.array_append(F.slice(acc["bullets"], F.lit(1), F.size(acc["bullets"]) - 1), last).alias("bullets"))
        return F.when(bullet, added).when(header & has, opened).when(has, joined).otherwise(titled)

    return F.aggregate(lines, zero, step, lambda a: F.filter(F.array_append(a["done"], pack(a)), lambda e: F.size(e["headers"]) + F.size(e["bullets"]) > 0))


def certification(line: Column) -> Column:
    """struct(name, issuer, year): issuer in brackets, after "by" or "from", or after a dash (up to 60 characters)."""
    text = squeeze(F.regexp_replace(line, BULLET, ""))
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    rest = squeeze(F.regexp_replace(text, r"\(?\b(?:19|20)\d{2}\b\)?", ""))
    forms = (r"^(.+?)\s*\(([^)]{2,60})\)\s*$", r"(?i)^(.+?)\s+(?:by|from)\s+(.{2,60})$", r"^(.+?)\s+[-–—]\s+(.{2,60})$")
    name, issuer = rest, F.lit(None).cast("string")
    for f in reversed(forms):
        name, issuer = F.when(rest.rlike(f), F.regexp_extract(rest, f, 1)).otherwise(name), F.when(rest.rlike(f), F.regexp_extract(rest, f, 2)).otherwise(issuer)
    return F.struct(F.regexp_replace(name, r"[\s,\-–—]+$", "").alias("name"), issuer.alias("issuer"), year.alias("year"))


def simple_list(lines: Column) -> Column:
    """Bullets off, short lines cut at commas, repetitions (case apart) dropped, in order."""
    items = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) < 100, F.split(F.regexp_replace(x, BULLET, ""), r"\s*[,;]\s*")).otherwise(F.array(F.regexp_replace(x, BULLET, "")))))
    return F.aggregate(F.filter(F.transform(items, strip), lambda x: x != ""), F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


_quoted = lambda words: "|".join(re.sub(r"([^\w\s])", r"\\\1", w.lower()) for w in words)


def project_names(text: Column) -> Column:
    """The project technologies that a text names, in their order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(rf"(?<!\w)(?:{_quoted((name, *keys))})(?!\w)"), name) for name, keys in PROJECT_TECHNOLOGIES.items()]))


def _technology_keys() -> dict[str, tuple[tuple[str, ...], ...]]:
    """Names in order, each with its keys as a project's technology, as a skill, and as a skill of one letter."""
    out = {name: (tuple(w.lower() for w in (name, *keys)), (), ()) for name, keys in PROJECT_TECHNOLOGIES.items()}
    for name, _, _, keys in SKILLS:
        own = out.get(name, ((), (), ()))
        out[name] = (own[0], own[1] + tuple(k for k in keys if len(k) > 1), own[2] + tuple(k for k in keys if len(k) == 1))
    return out


def _first_letters(words: list[str]) -> str:
    """A pattern of the words, parted by first letters, so that few are tried at a place."""
    return "|".join(f"{a}(?:{'|'.join(sorted(w[1:] for w in words if w[0] == a))})" for a in sorted({w[0] for w in words}))


def _nth(at: Column, tests: list[Column], first: int) -> Column:
    """tests[at - first], found by halves."""
    half = len(tests) // 2
    return F.when(at < first + half, _nth(at, tests[:half], first)).otherwise(_nth(at, tests[half:], first + half)) if half else tests[0]


def technologies(text: Column) -> Column:
    """All technologies that a text names as whole words: those of projects in their order, then other known skills in
    theirs. Names of one letter count as capitals that are not part of a sign like C++ or R&D.

    Each run of letters, digits and _ of a key is a whole word of a text with that key. So one scan finds the words that
    are a key's longest run, and only the names of the words found are looked for with their own patterns.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    known = _technology_keys()
    by_word: dict[str, list[int]] = {}
    tests = []
    for i, (project, skill, letters) in enumerate(known.values()):
        for word in {*(max(re.findall(r"[a-z0-9_]+", k), key=len) for k in project + skill), *(k.upper() for k in letters)}:
            by_word.setdefault(word, []).append(i)
        forms = [low.rlike(rf"(?<!\w)(?:{_quoted(project)})(?!\w)")] if project else []
        forms += [low.rlike(rf"(?<![\w.])(?:{_quoted(skill)})(?!\w)")] if skill else []
        forms += [text.rlike(rf"(?<![\w.&+#'’-]){k.upper()}(?![\w&+#'’-])") for k in letters]
        tests.append(reduce(lambda a, b: a | b, forms))
    letters = "".join(sorted(w for w in by_word if w.isupper()))
    words = F.regexp_extract_all(low, F.lit(rf"(?<!\w)(?:{_first_letters([w for w in by_word if not w.isupper()])})(?!\w)"), F.lit(0))
    capitals = F.regexp_extract_all(text, F.lit(rf"(?<!\w)[{letters}](?!\w)"), F.lit(0))
    places = F.create_map(*[x for w, at in by_word.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in at]))])
    maybe = F.array_sort(F.array_distinct(F.flatten(F.transform(F.concat(words, capitals), lambda w: F.element_at(places, w)))))
    names = F.array(*[F.lit(name) for name in known])
    named = F.filter(maybe, lambda at: _nth(at, tests, 0))
    return F.transform(named, lambda at: F.element_at(names, at + 1))


#: Words that ran together and what they read as, applied in this order, case apart.
CRUSHED = (
    (r"\bDevlopinganAI\b", "Developing an AI"), (r"\bCreateapipelineusing", "Create a pipeline using"), (r"\bCreateapipeline", "Create a pipeline"), (r"\bpipelinetoclean\b", "pipeline to clean"),
    (r"\bplanningapp\b", "planning app"), (r"\bappusing\b", "app using"), (r"\btravelplanning\b", "travel planning"),
    (r"\bAI-poweredtravelplanningappusing\s*Lang\s*Chain\b", "AI-powered travel planning app using LangChain"), (r"\btravelplanningappusing\s*Lang\s*Chain\b", "travel planning app using LangChain"),
    (r"\bAI-poweredtravelplanningappusing\b", "AI-powered travel planning app using"), (r"\bcuttingplanningtimeby(?=\d|\b)", "cutting planning time by"), (r"\bcuttingplanning\b", "cutting planning"),
    (r"\btimeby(?=\d|\b)", "time by"), (r"\brecordsforNLProlesin(?=[A-Z]|\b)", "records for NLP roles in"), (r"\brecordsfor\b", "records for"), (r"\bforNLProlesin(?=[A-Z]|\b)", "for NLP roles in"),
    (r"\bNLProlesin(?=[A-Z]|\b)", "NLP roles in"), (r"\bforNLP\b", "for NLP"), (r"\brolesinIndiausing(?=[A-Z]|\b)", "roles in India using"), (r"\binIndiausing(?=[A-Z]|\b)", "in India using"),
    (r"\brolesin\b", "roles in"), (r"\bIndiausing(?=[A-Z]|\b)", "India using"), (r"\busingPython(?=[A-Z]|\b)", "using Python"), (r"\bPythonand\b", "Python and "), (r"\bandReact\b", "and React"),
    (r"\bPrototypedofpowerbank\b", "Prototyped power bank"), (r"\bWi-Fismartplug\b", "Wi-Fi smart plug"), (r"\bFullyHomeAutomationBoard\b", "Fully Home Automation Board"), (r"\bBuilt an memory\b", "Built a memory"),
)
#: Names that the spacing below must not part.
REJOINED = ((r"\bLang\s+Chain\b", "LangChain"), (r"\bPy\s+MuPDF\b", "PyMuPDF"), (r"\bESP\s+32\b", "ESP32"), (r"\bESP\s+8266\b", "ESP8266"), (r"\bF\s+1\b", "F1"), (r"(?i)\b(\d+)\s+k\b", "$1k"), (r"(?i)\b(\d+)\s+ms\b", "$1ms"))


def crushed(text: Column) -> Column:
    """A description with words that ran together parted: known ones, small letters before a capitalised word, letters
    and numbers; doubled commas and spaces off, a capital first. Null and empty texts are null."""
    for wrong, right in CRUSHED:
        text = F.regexp_replace(text, f"(?i){wrong}", right)
    text = F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    text = F.regexp_replace(text, r"\s*,\s*,\s*", ", ")
    for parted, right in REJOINED:
        text = F.regexp_replace(text, parted, right)
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^[ ,]+|[ ,]+$", "")
    return F.nullif(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))), F.lit(""))


#: Labels of contact lines.
CONTACT = r"(?i)(?:email|e-?mail|phone|mobile|linkedin|github|gitlab|portfolio|website|contact|address)\s*[:\-]?"


def contact_lines(lines: DataFrame, key: str = "doc_id", order: str = "line_no", most: int = 12) -> DataFrame:
    """key, order, line: header lines, and of the summary's first `most` lines (the rule's own limit) those with an
    address, a number, a link or a contact label that are not there yet. lines has the section of each line."""
    from pyspark.sql import Window

    text = F.trim("line")
    signal = text.rlike(r"[\w.+-]+@[\w-]+\.\w+") | text.rlike(r"\+?\d[\d\s().-]{8,}\d") | text.rlike(r"(?i)https?://|www\.") | text.rlike(CONTACT)
    n = F.row_number().over(Window.partitionBy(key, "section").orderBy(order))
    picked = lines.withColumn("n", n).filter((F.col("section") == "header") | (F.col("section") == "summary") & (F.col("n") <= most) & (text != "") & signal)
    again = F.row_number().over(Window.partitionBy(key, text).orderBy(F.col("section") != "header", order))
    return picked.withColumn("again", again).filter((F.col("section") == "header") | (F.col("again") == 1)).select(key, order, F.when(F.col("section") == "header", F.col("line")).otherwise(text).alias("line"))


def completeness_points(p: DataFrame, key: str = "cand_id") -> DataFrame:
    """key, points 0 to 18: two each for name, e-mail, phone, links, education, experience, projects and five skills, one
    each for awards and interests. Counts and texts may be null."""
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False)).cast("int")
    some = lambda c, least=1: F.coalesce(F.col(c) >= least, F.lit(False)).cast("int")
    two = [has(c) for c in ("name", "email", "phone")] + [some(c) for c in ("links", "degrees", "jobs", "projects")] + [some("skills", 5)]
    return p.select(key, (reduce(lambda a, b: a + b, two) * 2 + some("awards") + some("interests")).alias("points"))
