"""Choices between ways of reading: the better block of a section from another reader, a second look at an overlong
header, a person's name from ordered candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contacts import looks_like_name
from ..functions.text import strip, words
from .education import GRADE_FIRST, NAMED_GRADE
from .parsers import DEGREE, INSTITUTIONS, _holds
from .sections import match_headings

#: Words of education lines, how much better a block must be.
SCHOOL_WORDS = ("university", "college", "school", "academy", "b.tech", "class x", "class xii")
BETTER = 2.0
#: A header of more lines is looked at again, but for its first ones; lines in which a name is sought.
HEADER_MOST, HEADER_KEPT, NAME_LINES = 10, 6, 8
#: What is cleaned off a header's segment, in this order.
SEGMENT = (
    (r"/[A-Za-z_]+", " "),
    (r"[A-Za-z0-9][A-Za-z0-9_.+\-]*@[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", " "),
    (r"\+?\d[\d\s\-()]{8,}\d", " "),
    (r"(?i)(?:https?://)?(?:www\.)?(?:linkedin\.com/[^\s]+|github\.com/[^\s]+)", " "),
    (r"(?i)^(?:email|e-?mail|phone|mobile|linkedin|github|gitlab|portfolio|website|contact|address)\s*[:\-]?\s*", ""),
    (r"(?i)\b(?:email|e-?mail|phone|mobile|linkedin|github|gitlab|portfolio|website|contact|address)\s*[:\-]?\s*$", ""),
)


def section_blocks(marked: DataFrame, target: str, key: str = "doc_id") -> DataFrame:
    """The lines (key, source, line_no, line, section) of each reader's block of a section: from its first heading to the
    next heading of another, both by `section`."""
    own = Window.partitionBy(key, "source")
    first = F.min(F.when(F.col("section") == target, F.col("line_no"))).over(own)
    x = marked.withColumn("__first", first)
    stop = F.min(F.when((F.col("line_no") > F.col("__first")) & (F.col("section") != target), F.col("line_no"))).over(own)
    return x.withColumn("__stop", stop).filter((F.col("line_no") >= F.col("__first")) & (F.col("__stop").isNull() | (F.col("line_no") < F.col("__stop")))).drop("__first", "__stop")


def block_quality(blocks: DataFrame, target: str, key: str = "doc_id") -> DataFrame:
    """key, source, quality: lines that are no heading of the section, an eighth of their words (6 at most), and lines
    with a school's word."""
    content = ~F.coalesce(F.col("section") == target, F.lit(False))
    school = F.lit(False)
    for w in SCHOOL_WORDS:
        school |= F.contains(F.lower("line"), F.lit(w))
    n = F.sum(F.when(content, F.size(words(F.col("line")))).otherwise(0))
    return blocks.groupBy(key, "source").agg((F.count_if(content) + F.least(n / 8.0, F.lit(6.0)) + F.count_if(content & school)).alias("quality"))


def rescue(lines: DataFrame, best: DataFrame, dictionary: DataFrame, target: str = "education", key: str = "doc_id") -> DataFrame:
    """key, line_no, line, rescued: the best reader's lines (key, source in best), and behind them the block of the first
    other reader (by ord) whose block of the section is better by more than BETTER."""
    marked = match_headings(lines, dictionary, key)
    blocks = section_blocks(marked, target, key)
    scored = block_quality(blocks, target, key).join(lines.select(key, "source", "ord").distinct(), [key, "source"])
    chosen = best.select(key, F.col("source").alias("best"))
    x = scored.join(chosen, key)
    own = F.coalesce(F.max(F.when(F.col("source") == F.col("best"), F.col("quality"))).over(Window.partitionBy(key)), F.lit(0.0))
    better = x.withColumn("own", own).filter((F.col("source") != F.col("best")) & (F.col("quality") > F.col("own") + BETTER))
    taken = better.groupBy(key).agg(F.min_by("source", "ord").alias("source"))
    kept = lines.join(chosen.select(key, F.col("best").alias("source")), [key, "source"], "left_semi").select(key, "line_no", "line", F.lit(False).alias("rescued"))
    last = kept.groupBy(key).agg(F.max("line_no").alias("last"))
    added = blocks.join(taken, [key, "source"], "left_semi").join(last, key, "left")
    place = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    return kept.unionByName(added.select(key, place.alias("line_no"), "line", F.lit(True).alias("rescued")))


def adaptive_sections(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, pos (from 1), line: lines under their headings, where a heading counts only if it is bold or large
    (1.08 of the page's median). A header of more than HEADER_MOST lines is read again: behind its first HEADER_KEPT
    lines every known heading counts. What it gives to a section stands before what the section has.

    marked has size, font_median, is_bold, and the section that a line is the heading of.
    """
    strong = F.col("section").isNotNull() & (F.coalesce("is_bold", F.lit(False)) | F.coalesce(F.col("size") >= 1.08 * F.col("font_median"), F.lit(False)))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = marked.filter(strip(F.col("line")) != "").withColumn("__own", F.when(strong, F.col("section")))
    x = x.withColumn("__in", F.coalesce(F.last("__own", ignorenulls=True).over(before), F.lit("header"))).filter("__own IS NULL")
    group = Window.partitionBy(key, "__in")
    x = x.withColumn("__n", F.row_number().over(group.orderBy("line_no"))).withColumn("__all", F.count(F.lit(1)).over(group))
    again = (F.col("__in") == "header") & (F.col("__all") > HEADER_MOST)
    x = x.withColumn("__again", again).withColumn("__own", F.when(again & (F.col("__n") > HEADER_KEPT), F.col("section")))
    second = F.coalesce(F.last("__own", ignorenulls=True).over(group.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)), F.lit("header"))
    x = x.withColumn("__to", F.when(F.col("__again"), second).otherwise(F.col("__in"))).filter("__own IS NULL")
    place = F.row_number().over(Window.partitionBy(key, "__to").orderBy(F.col("__again").desc(), "line_no"))
    return x.select(key, F.col("__to").alias("section"), place.alias("pos"), "line")


def clean_segment(c: Column) -> Column:
    t = strip(c)
    for pattern, instead in SEGMENT:
        t = F.regexp_replace(t, pattern, instead)
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ |•·:-]+|[ |•·:-]+$", "")


def resolve_names(header: DataFrame, dictionary: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, name, how: of a header's lines, the first segment that is like a name ("segment"); else the first two lines
    together, if both are short words ("pair"); else the first line's first segment, of up to five words ("first")."""
    x = header.filter(strip(F.col("line")) != "").withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("__k") <= NAME_LINES)
    x = x.withColumn("clean", clean_segment(F.col("line")))
    x = match_headings(x.select(key, "__k", "clean", F.col("clean").alias("line")), dictionary, key)
    parts = F.transform(F.split("clean", r"\s*[|•·]\s*"), clean_segment)
    found = F.get(F.filter(parts, looks_like_name), F.lit(0))
    short = (F.col("clean") != "") & (F.size(words(F.col("clean"))) <= 2) & F.col("clean").rlike(r"^[A-Za-z][A-Za-z\s.'-]*$")
    per = x.groupBy(key).agg(
        F.min_by(found, F.when(F.col("section").isNull() & found.isNotNull(), F.col("__k"))).alias("segment"), F.count_if(short & (F.col("__k") <= 2)).alias("short"),
        F.min_by("clean", "__k").alias("one"), F.min_by("clean", F.when(F.col("__k") == 2, 2)).alias("two"),
    )
    pair = F.initcap(F.lower(F.concat_ws(" ", "one", "two")))
    first = F.trim(F.get(F.split("one", r"\s*[|•·]\s*"), F.lit(0)))
    fits = (F.size(words(first)) <= 5) & (first != "") & ~first.rlike(SEGMENT[1][0])
    name = F.when(F.col("segment").isNotNull(), F.col("segment")).when((F.col("short") == 2) & looks_like_name(pair), pair).when(fits, first)
    how = F.when(F.col("segment").isNotNull(), "segment").when((F.col("short") == 2) & looks_like_name(pair), "pair").when(fits, "first")
    return per.select(key, name.alias("name"), how.alias("how"))


#: The sections that make up a field, in order; others are fields by themselves. Header lines of no field.
FIELDS = {"awards": ("awards", "publications", "references"), "interests": ("interests", "activities"), "education": ("education", "courses")}
PERSONAL = ("male", "female", "dob", "date of birth")


def inferred_education(header: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, order, line: header lines, cleaned, that tell a degree, an institution or a grade, of documents with two or more
    such lines. Lines with an address or a number, and names of up to four words, are none."""
    line = strip(F.col("line"))
    contact = line.rlike(SEGMENT[1][0]) | line.rlike(SEGMENT[2][0]) | line.rlike(SEGMENT[3][0])
    x = header.filter((line != "") & ~contact).select(key, order, clean_segment(F.col("line")).alias("line"))
    c = F.col("line")
    told = c.rlike(DEGREE) | _holds(c, INSTITUTIONS) | c.rlike(NAMED_GRADE) | c.rlike(GRADE_FIRST) | c.rlike(r"[0-9]+(?:\.[0-9]+)?\s*%$")
    x = x.filter((c != "") & ~F.lower(c).isin(*PERSONAL) & ~(looks_like_name(c) & (F.size(words(c)) <= 4)) & told)
    return x.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("__n > 1").drop("__n")


def route(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, field, pos (from 1), line: the lines (section, line) of each field's sections, one section after the other. A
    document without lines of education takes them from its header."""
    of = {s: (f, i) for f, ss in FIELDS.items() for i, s in enumerate(ss)}
    field, place = F.col("section"), F.lit(0)
    for s, (f, i) in of.items():
        field, place = F.when(F.col("section") == s, f).otherwise(field), F.when(F.col("section") == s, i).otherwise(place)
    x = lines.select(key, order, "line", field.alias("field"), place.alias("__p"))
    without = x.groupBy(key).agg(F.max(F.col("field") == "education").alias("has")).filter("NOT has").select(key)
    inferred = inferred_education(x.filter("field = 'header'").join(without, key, "left_semi"), key, order)
    rows = x.unionByName(inferred.select(key, order, "line", F.lit("education").alias("field"), F.lit(0).alias("__p")))
    return rows.select(key, "field", F.row_number().over(Window.partitionBy(key, "field").orderBy("__p", order)).alias("pos"), "line")
