"""Repairs of a profile's fields: noise out of skills, swapped education fields, continued list items, repeated
sentences, technologies told by a project's own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of grades, dates and degrees among skills.
GRADE = r"(?i)^(?:gpa|cgpa|grade|marks|score)\s*[:=]?\s*[\d.]+"
DATES = r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{4}$|^\d{4}\s*[-–]\s*(?:\d{4}|present)$"
DEGREE = r"(?i)\b(?:bachelor|master|b\.?tech|m\.?tech|b\.?sc|m\.?sc|b\.?e|m\.?e|bca|mca|mba|diploma|intermediate|12th|10th|ssc|hsc)\s+(?:in|of)\b"
#: Words of institutions and fields of study, spellings that are put right.
INSTITUTION = r"(?i)\b(?:university|college|institute|school|academy|iit|nit|iiit|bits)\b"
FIELD = r"(?i)\b(?:computer science|engineering|data science|artificial intelligence|machine learning|electronics|mechanical|civil|commerce|science)\b"
SPELLINGS = ((r"(?i)\bDevloping\b", "Developing"), (r"(?i)\ban memory\b", "a memory"), (r"(?i)\bNodejs\b", "Node.js"), (r"(?i)\bsept\b", "Sept"), (r"(?i)\bReal-\s+ESRGAN\b", "Real-ESRGAN"))
#: Technologies by the words that tell them.
TECHNOLOGIES = {
    "Arduino": r"\barduino\b", "Raspberry Pi": r"\braspberry\s*pi\b", "ESP32": r"\besp[\s-]?32\b", "ESP8266": r"\besp[\s-]?8266\b", "MQTT": r"\bmqtt\b", "HTTP": r"\bhttp\b",
    "LangChain": r"\blang\s*chain\b", "Streamlit": r"\bstreamlit\b", "Large Language Models": r"\bllms?\b|large language model",
    "RAG (Retrieval-Augmented Generation)": r"\brag\b|retrieval[- ]augmented generation", "Vector Databases": r"\bvector databases?\b",
    "Natural Language Processing": r"\bnlp\b|natural language processing", "PyMuPDF": r"\bpy\s*mupdf\b", "Pillow": r"\bpillow\b", "python-pptx": r"\bpython-pptx\b",
    "Pandas": r"\bpandas\b", "scikit-learn": r"\bscikit[- ]learn\b",
}
#: The most technologies that a repair adds, its own limit.
MOST = 8


def tidy(c: Column) -> Column:
    """Dashes spaced, white space folded, edges and doubled commas off, known misspellings put right; null if empty."""
    t = F.regexp_replace(F.regexp_replace(c, "[–—]", " - "), r"\s+", " ")
    t = F.regexp_replace(t, r"^[ ,\-]+|[ ,\-]+$", "")
    for wrong, right in SPELLINGS:
        t = F.regexp_replace(t, wrong, right)
    return F.nullif(F.regexp_replace(F.regexp_replace(t, r"\s*,\s*,", ", "), r"\s+([,.:;!?])", "$1"), F.lit(""))


def clean_skills(skills: DataFrame, degrees: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, order, skill: without grades, dates, degrees, numbers, institutions of the person's own education (whole names
    and words of six letters or more) and repetitions; the first of each stays."""
    name = F.lower(F.trim("institution"))
    blocked = degrees.filter("institution <> ''").select(key, F.explode(F.array_union(F.array(name), F.split(name, r"\s+"))).alias("word")).filter("length(word) > 5")
    blocked = blocked.groupBy(key).agg(F.collect_set("word").alias("words"))  # of one person's education
    text = F.trim("skill")
    low = F.lower(text)
    noise = low.rlike(GRADE) | low.rlike(DATES) | low.rlike(DEGREE) | text.rlike(r"^[\d./]+$")
    kept = skills.join(blocked, key, "left").filter((text != "") & ~noise & ~F.coalesce(F.exists("words", lambda w: F.contains(low, w)), F.lit(False)))
    first = F.row_number().over(Window.partitionBy(key, low).orderBy(order))
    return kept.select(key, order, text.alias("skill"), first.alias("n")).filter("n = 1").drop("n")


def repair_education(entries: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, order, institution, degree, field_of_study: dates out of the institution, swapped fields back, a field of
    study out of the degree; entries without either go, and of equal ones (with their start) the first stays."""
    dated = F.col("i").rlike(r"\b(?:19|20)\d{2}\b") & F.col("i").rlike(r"(?i)(?:present|current|\-|–|—)")
    is_place = lambda c: F.coalesce(F.col(c).rlike(INSTITUTION), F.lit(False))
    x = entries.select(key, order, "start", tidy(F.col("institution")).alias("i"), tidy(F.col("degree")).alias("d"), tidy(F.col("field_of_study")).alias("f"))
    x = x.withColumn("dated", F.coalesce(dated, F.lit(False)))
    x = x.withColumn("moved", F.col("dated") & is_place("d"))
    x = x.withColumn("i", F.when(F.col("moved"), F.col("d")).when(~F.col("dated"), F.col("i"))).withColumn("d", F.when(~F.col("moved"), F.col("d")))
    x = x.withColumn("swap", F.col("i").isNotNull() & F.col("d").isNotNull() & is_place("d") & ~is_place("i"))
    x = x.select(key, order, "start", "f", F.when(F.col("swap"), F.col("d")).otherwise(F.col("i")).alias("i"), F.when(F.col("swap"), F.col("i")).otherwise(F.col("d")).alias("d"))
    x = x.withColumn("taken", F.col("f").isNull() & F.coalesce(F.col("d").rlike(FIELD), F.lit(False)))
    x = x.select(key, order, "start", F.col("i").alias("institution"), F.when(~F.col("taken"), F.col("d")).alias("degree"), F.when(F.col("taken"), F.col("d")).otherwise(F.col("f")).alias("field_of_study"))
    same = Window.partitionBy(key, *[F.lower(F.coalesce(c, F.lit(""))) for c in ("institution", "degree", "start")]).orderBy(order)
    return x.filter("institution IS NOT NULL OR degree IS NOT NULL").withColumn("n", F.row_number().over(same)).filter("n = 1").drop("n", "start")


def repair_list(items: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, order, item: items that start in lower case or with and, or, with, affiliated, achieving go on the one before,
    if there is one; items already there (in any case) are left out; so, at the end, are those that another one holds."""
    x = items.select(key, F.struct(F.col(order).alias("o"), tidy(F.col("item")).alias("item")).alias("x")).filter("x.item IS NOT NULL")
    per = x.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))  # one person's list
    first = lambda c: F.substring(c, 1, 1)
    goes_on = lambda c: (first(c) != F.upper(first(c))) | F.lower(c).rlike("^(and|or|with|affiliated|achieving) ")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["o"].alias("o"), F.concat(last["item"], F.lit(" "), s["item"]).alias("item"))
        joined = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)
        known = F.exists(acc, lambda k: F.lower(k["item"]) == F.lower(s["item"]))
        return F.when((F.size(acc) > 0) & goes_on(s["item"]), joined).when(known, acc).otherwise(F.array_append(acc, s))

    whole = per.select(key, F.aggregate("xs", F.array().cast(per.schema["xs"].dataType), step).alias("xs"))
    held = lambda s: F.exists("xs", lambda k: (F.lower(k["item"]) != F.lower(s["item"])) & F.contains(F.lower(k["item"]), F.lower(s["item"])))
    return whole.select(key, F.explode(F.filter("xs", lambda s: ~held(s))).alias("s")).select(key, F.col("s.o").alias(order), F.col("s.item").alias("item"))


def compare_form(c: Column) -> Column:
    """Lower case, signs as spaces, articles and "and" out."""
    t = F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(and|the|a|an)\b", " "), r"\s+", " "))


def distinct_sentences(items: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, items: a person's sentences in order, without those that hold or are held by one kept before them."""
    text = F.regexp_replace(F.regexp_replace(F.trim("item"), r"\s+", " "), r"^[ ,]+|[ ,]+$", "")
    rows = items.select(key, F.struct(F.col(order).alias("o"), text.alias("t"), compare_form(text).alias("n")).alias("s")).filter("s.t <> ''")
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("all"))  # one person's list
    kept = F.array().cast(rows.selectExpr("array(s)").schema[0].dataType)

    def step(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda k: F.contains(k["n"], x["n"]) | F.contains(x["n"], k["n"]))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(x)))

    return per.select(key, F.array_join(F.transform(F.aggregate("all", kept, step), lambda s: s["t"]), "; ").alias("items"))


def repair_personal(people: DataFrame, key: str = "cand_id") -> DataFrame:
    """key, name, headline: a trailing field label off the name; no headline that is the place or holds an address."""
    labels = r"(?i)\b(?:email|e-?mail|phone|mobile|linkedin|github|portfolio|website|contact|address)\s*:?\s*$"
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(tidy(F.col("name")), labels, ""), r"\s+", " "), r"^[ |:\-]+|[ |:\-]+$", "")
    low = F.lower(tidy(F.col("headline")))
    bad = low.eqNullSafe(F.lower(tidy(F.col("location")))) | low.rlike("https?://|@")
    return people.select(key, F.nullif(name, F.lit("")).alias("name"), F.when(~bad, tidy(F.col("headline"))).alias("headline"))


def infer_technologies(projects: DataFrame, skills: DataFrame, key: str = "cand_id", order: str = "pos") -> DataFrame:
    """key, order, technologies: of projects that list none, the person's skills (in order) that the name or description
    has as whole words, or closed up, of four letters or more; then TECHNOLOGIES by their patterns; MOST in all."""
    mine = skills.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "skill"))), lambda s: s["skill"])).alias("skills"))
    text = F.lower(F.concat_ws(" ", F.nullif("name", F.lit("")), F.nullif("description", F.lit(""))))
    close = lambda c: F.regexp_replace(c, "[^a-z0-9+#]+", "")
    x = projects.filter(~F.coalesce(F.col("technology") != "", F.lit(False))).join(mine, key, "left").withColumn("text", text).withColumn("closed", close(text))

    def told(s: Column) -> Column:
        whole = F.regexp_like(F.col("text"), F.concat(F.lit(r"(?<!\w)\Q"), F.lower(s), F.lit(r"\E(?!\w)")))
        return whole | ((F.length(close(F.lower(s))) >= 4) & F.contains(F.col("closed"), close(F.lower(s))))

    own = F.coalesce(F.filter("skills", told), F.array().cast("array<string>"))
    known = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in TECHNOLOGIES.items()]), lambda n: n.isNotNull())
    more = F.filter(known, lambda n: ~F.exists(own, lambda s: F.lower(s) == F.lower(n)))
    return x.select(key, order, F.array_join(F.slice(F.concat(own, more), 1, MOST), ", ").alias("technologies"))
