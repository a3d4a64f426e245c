"""Page geometry: columns, lines, blocks, reading order, layout report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def column_gap(words: DataFrame, width: float, height: float) -> DataFrame:
    """doc_id, page, gap: centre of the longest empty run of 8-point bins between 28 % and 72 % of the width, if it is at
    least 18 points wide, three words stand on each side, and the left side has 15 % to 85 % of eight or more words."""
    body = words.filter((F.col("top") >= 0.12 * height) & (F.col("top") <= 0.92 * height)).withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    low, high = int(width * 0.28 // 8), int(width * 0.72 // 8)
    full = body.withColumn("bin", F.floor(F.col("c") / 8).cast("int")).groupBy(*PAGE, "bin").agg(F.count(F.lit(1)).alias("n"))
    total = full.groupBy(*PAGE).agg(F.sum("n").alias("words"))
    inner = full.filter(F.col("bin").between(low, high)).select(*PAGE, "bin")
    ends = total.select(*PAGE, F.explode(F.array(F.lit(low - 1), F.lit(high + 1))).alias("bin"))
    order = Window.partitionBy(*PAGE).orderBy("bin")
    runs = inner.unionByName(ends).withColumn("next", F.lead("bin").over(order)).filter("next - bin > 1").withColumn("size", F.col("next") - F.col("bin") - 1)
    best = runs.groupBy(*PAGE).agg(F.max_by(F.struct("bin", "size"), F.struct("size", (-F.col("bin")).alias("o"))).alias("b")).select(*PAGE, ((F.col("b.bin") + 1) * 8.0).alias("from"), F.col("b.size").alias("size"))
    best = best.filter(F.col("size") * 8 >= 18).withColumn("gap", F.col("from") + F.col("size") * 4.0)
    sides = body.join(best, PAGE).groupBy(*PAGE, "gap").agg(F.count_if(F.col("c") < F.col("gap")).alias("l"), F.count(F.lit(1)).alias("n"))
    share = F.col("l") / F.col("n")
    return sides.filter((F.col("n") >= 8) & (F.col("l") >= 3) & (F.col("n") - F.col("l") >= 3) & (share >= 0.15) & (share <= 0.85)).select(*PAGE, "gap")


def assign_column(lines: DataFrame, gaps: DataFrame, width: float) -> DataFrame:
    """lines with column: -1 without a gap or for more than 48 % of the width, else 0 or 1 by the centre."""
    x = lines.join(gaps, PAGE, "left")
    centre = (F.col("x0") + F.col("x1")) / 2
    return x.withColumn("column", F.when(F.col("gap").isNull() | (F.col("x1") - F.col("x0") > 0.48 * width), -1).when(centre < F.col("gap"), 0).otherwise(1)).drop("gap")


def reading_order(lines: DataFrame, height: float) -> DataFrame:
    """lines with their place: the top band (14 % of the height), then full width and left by top, then right."""
    band = F.when(F.col("top") <= 0.14 * height, 0).otherwise(1)
    side = F.when((band == 1) & (F.col("column") == 1), 1).otherwise(0)
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(band, side, "top", "x0", "line_no")))


def line_blocks(lines: DataFrame) -> DataFrame:
    """lines with block: a new one at a column change or a gap of more than 1.6 times the line before (5 points at least)."""
    order = Window.partitionBy(*PAGE).orderBy("place")
    gap = F.col("top") - F.lag("bottom").over(order)
    tall = F.greatest(F.lag(F.col("bottom") - F.col("top")).over(order) * 1.6, F.lit(5.0))
    new = (F.lag("column").over(order) != F.col("column")) | (gap > tall)
    return lines.withColumn("__new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("block", F.sum("__new").over(order)).drop("__new")


def bold_lines(words: DataFrame) -> DataFrame:
    """doc_id, page, line_no, is_bold: more than half of the words in a bold font."""
    return words.groupBy(*PAGE, "line_no").agg((F.avg(F.contains(F.lower("font"), F.lit("bold")).cast("double")) > 0.5).alias("is_bold"))


def layout_report(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, two_column, headings, lines) by document: layout, heading density, confidence in the order."""
    g = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("two_column").alias("two"), F.sum("headings").alias("h"), F.sum("lines").alias("n"))
    layout = F.when(F.col("two") == 0, "single_column").when(F.col("two") == F.col("pages"), "two_column").otherwise("mixed")
    sure = 0.72 + F.when(F.col("two") == 0, 0.18).otherwise(0.0) - F.when(F.col("two") > 0, 0.08).otherwise(0.0) + F.when(F.col("h") >= 3, 0.06).otherwise(0.0)
    return g.select("doc_id", layout.alias("layout"), F.round(F.col("h") / F.greatest("n", F.lit(1)), 4).alias("heading_density"), F.round(F.least(sure, F.lit(1.0)), 4).alias("order_confidence"))


def font_median(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id").agg(F.coalesce(F.median("size"), F.lit(10.0)).alias("font_median"))
