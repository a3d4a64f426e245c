"""Headline, location, strict section splits, and where in a document a value came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contacts import EMAIL, URL
from ..functions.text import dice, tokens, words
from .sections import clean_heading
from .signatures import block_features, section_scores

#: Words that mark an institution, and cities known without their state.
INSTITUTIONS = "university|college|institute|school|academy"
CITIES = ("Pune", "Mumbai", "Bangalore", "Bengaluru", "Hyderabad", "Chennai", "Delhi", "London", "Berlin", "Paris", "Madrid", "Toronto", "Singapore", "New York")


def is_headline(line: Column) -> Column:
    """Two to twelve words without digits, addresses or links."""
    return F.size(words(line)).between(2, 12) & ~line.rlike(rf"\d|{EMAIL}|{URL}")


def headlines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, headline: the first such line among lines 1 to 7."""
    return lines.filter(F.col("line_no").between(1, 7) & is_headline(F.col("line"))).groupBy(key).agg(F.min_by("line", "line_no").alias("headline"))


def location(line: Column) -> Column:
    """"City, State" of a line without institution words, else a known city in a line of up to 60 characters; or null."""
    pair = r"\b([A-Z][A-Za-z.]*(?: [A-Z][A-Za-z.]*){0,2}, ?[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?)\b"
    city = rf"\b({'|'.join(CITIES)})\b"
    known = F.when(F.length(line) <= 60, F.nullif(F.regexp_extract(line, city, 1), F.lit("")))
    return F.when(~line.rlike(rf"(?i)\b(?:{INSTITUTIONS})\b"), F.coalesce(F.nullif(F.regexp_extract(line, pair, 1), F.lit("")), known))


def strict_sections(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with their section, where a heading counts only if it is bold, large (1.05 medians) or of up to four words."""
    strong = F.coalesce("is_bold", F.lit(False)) | F.coalesce(F.col("size") >= 1.05 * F.col("font_median"), F.lit(False)) | (F.size(words(clean_heading(F.col("line")))) <= 4)
    x = marked.withColumn("__own", F.when(strong, F.col("section")))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("in_section", F.coalesce(F.last("__own", ignorenulls=True).over(before), F.lit("header"))).filter("__own IS NULL").drop("__own")


def signatures(lines: DataFrame, key: str) -> DataFrame:
    """key, best_section, best_score of groups of lines; key may be a struct."""
    return section_scores(block_features(lines, key)).select(key, "best_section", "best_score")


def state_sections(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with in_section by a state machine: every heading switches. Before the first, lines in the upper 18 % of page
    0 are the header; the first other line whose own signature reaches 0.55 switches too, as a heading does, and goes.
    Then sections of under four lines take the section of their signature, from 0.52 on, each judged by its own lines.

    marked has page (from 0), top, height and the section that a line is the heading of.
    """
    own = Window.partitionBy(key)
    zone = (F.col("page") == 0) & (F.col("top") <= 0.18 * F.col("height"))
    x = marked.withColumn("__first", F.min(F.when(F.col("section").isNotNull(), F.col("line_no"))).over(own))
    early = x.filter(F.col("section").isNull() & ~F.coalesce(zone, F.lit(False)) & (F.col("__first").isNull() | (F.col("line_no") < F.col("__first"))))
    known = signatures(early.select(F.struct(key, "line_no").alias("at"), "line_no", "line"), "at").filter("best_score >= 0.55")
    switch = known.groupBy(F.col(f"at.{key}").alias(key)).agg(F.min("at.line_no").alias("__at"), F.min_by("best_section", "at.line_no").alias("__signed"))
    x = x.join(switch, key, "left").withColumn("__own", F.coalesce("section", F.when(F.col("line_no") == F.col("__at"), F.col("__signed"))))
    before = own.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("in_section", F.coalesce(F.last("__own", ignorenulls=True).over(before), F.lit("header"))).filter("__own IS NULL").drop("__own", "__first", "__at", "__signed")
    x = x.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key, "in_section"))).withColumn("at", F.struct(key, "in_section"))
    small = signatures(x.filter("__n < 4 AND in_section <> 'header'").select("at", "line_no", "line"), "at").filter("best_score >= 0.52")
    return x.join(small.select("at", F.col("best_section").alias("__other")), "at", "left").withColumn("in_section", F.coalesce("__other", "in_section")).drop("at", "__n", "__other")


def block_sections(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, block, line_no, line, in_section, block by block: a heading in a block's first line switches and goes;
    before any, the first three blocks of page 0 that begin in its upper 18 % are the header; another block's signature
    switches from 0.48 on in the header, from 0.60 on elsewhere.

    marked has page and block (from 0), top, height and the section that a line is the heading of.
    """
    x = marked.withColumn("at", F.struct(key, "page", "block"))
    first = lambda c: F.min_by(c, "line_no")
    blocks = x.groupBy("at").agg(
        first("section").alias("heading"), (first("top") <= 0.18 * first("height")).alias("high"),
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"),
    ).join(signatures(x.select("at", "line_no", "line"), "at"), "at")
    zone = (F.col("at.page") == 0) & (F.col("at.block") <= 2) & F.coalesce("high", F.lit(False))
    b = F.struct("at.page", "at.block", "lines", "heading", zone.alias("zone"), "best_section", F.coalesce("best_score", F.lit(0.0)).alias("score"))
    docs = blocks.select(F.col(f"at.{key}").alias(key), b.alias("b")).groupBy(key).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    zero = F.struct(F.lit("header").alias("now"), F.lit(False).alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(a, b):
        header = ~a["seen"] & b["zone"]
        signed = b["best_section"].isNotNull() & (b["score"] >= F.when(a["now"] == "header", 0.48).otherwise(0.6))
        now = F.when(b["heading"].isNotNull(), b["heading"]).when(~header & signed, b["best_section"]).otherwise(a["now"])
        return F.struct(now.alias("now"), (a["seen"] | b["heading"].isNotNull()).alias("seen"), F.array_append(a["out"], F.when(b["heading"].isNull() & header, "header").otherwise(now)).alias("out"))

    z = docs.select(key, F.explode(F.arrays_zip("bs", F.aggregate("bs", zero, step, lambda a: a["out"]).alias("in_section"))).alias("z"))
    rows = z.select(key, "z.bs.page", "z.bs.block", F.col("z.bs.heading").isNotNull().alias("head"), "z.in_section", F.posexplode("z.bs.lines").alias("no", "l"))
    return rows.filter("NOT head OR no > 0").select(key, "page", "block", "l.line_no", "l.line", "in_section")


def likeness(value: Column, line: Column) -> Column:
    """1 for equal texts, the share of lengths where one holds the other, else the Dice overlap of their words."""
    a, b = F.lower(F.trim(value)), F.lower(F.trim(line))
    n, m = F.length(a), F.length(b)
    return F.when(a == b, 1.0).when(F.contains(b, a) | F.contains(a, b), F.least(n, m) / F.greatest(n, m)).otherwise(dice(tokens(a), tokens(b)))


def locate(values: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """values (key, field, value) with the line that is most like each and how much; the first of equal lines."""
    x = values.join(lines, key).withColumn("__s", F.round(likeness(F.col("value"), F.col("line")), 6))
    best = F.struct("__s", (-F.col("line_no")).alias("o"))
    return x.groupBy(key, "field").agg(F.max_by("line_no", best).alias("line_no"), F.max("__s").alias("likeness"))


def entry_groups(lines: DataFrame, starts: Column, key: str = "doc_id") -> DataFrame:
    """lines with entry: a new one at every start but the first line's."""
    order = Window.partitionBy(key).orderBy("line_no")
    new = F.when(F.row_number().over(order) > 1, starts.cast("int")).otherwise(0)
    return lines.withColumn("__new", new).withColumn("entry", F.sum("__new").over(order)).drop("__new")
