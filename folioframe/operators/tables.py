"""Sidebars and their reading order, skills out of tables, link normal forms, exact scores, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import PAGE

#: Words of table heads and ratings.
HEAD_WORDS = ("skill", "skills", "category", "level", "rating", "proficiency", "experience", "years", "name", "tools")
RATING = r"(?i)^(?:\d{1,2}(?:/\d{1,2})?|\d{1,3}%|expert|advanced|intermediate|beginner|good|basic|[★☆*]+)$"


def sidebars(lines: DataFrame, width: float) -> DataFrame:
    """doc_id, page, sidebar: the column (0 or 1) whose lines are narrow (mean up to 28 % of the width) and up to three
    quarters as many as the other's; null without one."""
    g = lines.filter("column >= 0").groupBy(*PAGE).agg(
        *[F.count_if(F.col("column") == c).alias(f"n{c}") for c in (0, 1)], *[F.avg(F.when(F.col("column") == c, F.col("x1") - F.col("x0"))).alias(f"w{c}") for c in (0, 1)],
    )
    narrow = lambda a, b: (F.col(f"w{a}") <= 0.28 * width) & (F.col(f"n{a}") <= 0.75 * F.col(f"n{b}"))
    return g.select(*PAGE, F.when(narrow(1, 0), 1).when(narrow(0, 1), 0).cast("bigint").alias("sidebar"))


def smart_order(lines: DataFrame, side: DataFrame) -> DataFrame:
    """lines with their place: full width first, then the main column, then the sidebar (else left, then right)."""
    x = lines.join(side, PAGE, "left")
    rank = F.when(F.col("column") < 0, 0).when(F.col("sidebar").isNull(), 1 + F.col("column")).when(F.col("column") == F.col("sidebar"), 2).otherwise(1)
    return x.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(rank, "top", "x0", "line_no"))).drop("sidebar")


def table_skills(cells: DataFrame) -> DataFrame:
    """doc_id, skill: cells (doc_id, tbl, row, col, text) without a head row (half of its cells are head words) and
    without columns of ratings (seven tenths), cut at commas; short, worded items once each."""
    low = F.lower(F.trim("text"))
    key = ["doc_id", "tbl"]
    head = cells.filter("row = 0").groupBy(*key).agg((F.avg(low.isin(*HEAD_WORDS).cast("double")) >= 0.5).alias("head"))
    body = cells.join(head, key, "left").filter(~F.coalesce("head", F.lit(False)) | (F.col("row") > 0))
    rated = body.groupBy(*key, "col").agg((F.avg(F.trim("text").rlike(RATING).cast("double")) >= 0.7).alias("rated"))
    kept = body.join(rated, [*key, "col"]).filter(~F.col("rated") & (F.length("text") <= 100))
    items = kept.select("doc_id", F.explode(F.split("text", r"\s*,\s*")).alias("skill")).select("doc_id", F.trim("skill").alias("skill"))
    return items.filter((F.length("skill") > 1) & (F.length("skill") <= 60) & ~F.col("skill").rlike(RATING)).distinct()


def text_skills(line: Column) -> Column:
    """Skills of a table that came as text: a leading category off, cut at commas, bars, tabs and wide spaces."""
    body = F.regexp_replace(line, r"^[A-Za-z &]{2,30}:\s*", "")
    parts = F.transform(F.split(body, r"\s*[,|/\t•]\s*|\s{2,}"), lambda x: F.trim(F.regexp_replace(x, r"\s*\([^)]*\)$", "")))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x).between(2, 60)))


def normalize_link(label: Column, url: Column) -> Column:
    """An address with its scheme; bare LinkedIn and GitHub names (with a digit or hyphen) in full; placeholders empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    slug = u.rlike(r"^[A-Za-z0-9-]+$") & u.rlike(r"[0-9-]")
    return (
        F.when(F.lower(u).isin("", "n/a", "none", "link", "url", "-"), "")
        .when(u.rlike("(?i)^https?://"), u)
        .when(slug & (label == "LinkedIn"), F.concat(F.lit("https://www.linkedin.com/in/"), u))
        .when(slug & (label == "GitHub"), F.concat(F.lit("https://github.com/"), u))
        .when(u.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/.*)?$"), F.concat(F.lit("https://"), u))
        .otherwise(u)
    )


def exact_score(pairs: DataFrame, *fields: str) -> Column:
    """Share of the fields with a truth (t_<field>) whose found value (f_<field>) is the same, case and ends apart."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    asked = sum((F.when(clean(f"t_{f}") != "", 1).otherwise(0) for f in fields), F.lit(0))
    right = sum((F.when((clean(f"t_{f}") != "") & (clean(f"t_{f}") == clean(f"f_{f}")), 1).otherwise(0) for f in fields), F.lit(0))
    return F.when(asked > 0, F.round(right / asked, 6)).otherwise(1.0)


def manifest(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, strategies, mean_score, best_score, tag: how well a document's strategies do, as one word."""
    g = scored.groupBy(key).agg(F.count(F.lit(1)).alias("strategies"), F.round(F.round(F.avg("global_score"), 9), 6).alias("mean_score"), F.max("global_score").alias("best_score"))
    return g.withColumn("tag", F.when(F.col("best_score") < 0.4, "hard").when(F.col("mean_score") >= 0.7, "easy").otherwise("mixed"))
